"""Scores with many rows per variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.functions.numeric import finite, parsed, row_mean
from codonloom.functions.text import in_parentheses
from codonloom.operators.summarize import max_per_key

RANK_SUFFIX = "_rankscore"


def rank_columns(*frames: DataFrame) -> list[str]:
    """Rank-score columns present in every frame, in the order of the first."""
    common = set(frames[0].columns).intersection(*[f.columns for f in frames[1:]])
    return [c for c in frames[0].columns if c.endswith(RANK_SUFFIX) and c in common]


def numeric_scores(df: DataFrame, columns) -> DataFrame:
    """Scores as numbers; the PolyPhen number stands in parentheses."""
    def number(c: str):
        return parsed(in_parentheses(c) if c.lower() == "polyphen" else c)

    return df.withColumns({c: number(c) for c in columns}).withColumns({c: finite(c) for c in columns})


def variant_scores(raw: DataFrame, ranks=None) -> DataFrame:
    """One row per variant: column-wise maxima and the mean of the rank scores."""
    ranks = list(ranks) if ranks is not None else rank_columns(raw)
    columns = ["SIFT", "PolyPhen", "Condel", *ranks]
    numbers = numeric_scores(raw.select("Uploaded_variation", *columns), columns)
    best = max_per_key(numbers, "Uploaded_variation", columns)
    return best.select(
        "Uploaded_variation", F.col("SIFT").alias("sift"), F.col("PolyPhen").alias("polyphen"),
        F.col("Condel").alias("condel"), row_mean(ranks).alias("average_rank"),
    )
