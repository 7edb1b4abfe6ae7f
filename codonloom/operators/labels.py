"""Codon-level driver labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.functions.text import codon_key, split_pair
from codonloom.operators.clean import recode_presence
from codonloom.operators.relate import spread_join
from codonloom.sources.schemas import LABEL


def codon_labels(hotspots: DataFrame) -> DataFrame:
    """Codon id and its gene."""
    gene, codon = split_pair("codon_id", "_")
    return hotspots.select(
        F.col("codon_id").alias("driver_mutation"), gene.alias("driver_gene"), codon.alias("codon"))


def with_codon_key(df: DataFrame, target: str = "codon_id") -> DataFrame:
    return df.withColumn(target, codon_key("Hugo_Symbol", "First_amino_acid", "Position"))


def label_by_codon(df: DataFrame, labels: DataFrame, dedup: bool = True, key: str = "codon_id") -> DataFrame:
    """1 for any substitution at a listed codon, else 0.

    A codon listed twice would repeat its mutations; `dedup` lists each codon once.
    """
    listed = labels.select("driver_mutation", F.lit(1).alias("_listed"))
    joined = spread_join(df, listed.distinct() if dedup else listed, key, "driver_mutation", "left")
    return recode_presence(joined, "_listed", LABEL).drop("_listed")
