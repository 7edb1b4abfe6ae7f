"""Feature importance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonloom.learn.evaluate import auc
from codonloom.learn.validate import score_expression
from codonloom.operators.ordering import hash_rank
from codonloom.session import stage
from codonloom.sources.schemas import GENE_FEATURES, VARIANT_SCORES


def spread_to_100(table: DataFrame, column: str = "importance", target: str = "overall") -> DataFrame:
    """Stretch a column so that its least value becomes 0 and its largest 100; all equal becomes 0."""
    low, top = table.agg(F.min(column)).scalar(), table.agg(F.max(column)).scalar()
    return table.withColumn(target, F.coalesce(100 * F.try_divide(F.col(column) - low, top - low), F.lit(0.0)))


def impurity_importance(spark: SparkSession, model, names) -> DataFrame:
    """Importance of each input of a tree model: as the model has it, and `overall` from 0 to 100."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    return spread_to_100(spark.createDataFrame(list(zip(names, values)), "feature_name string, importance double"))


def permutation_importance(model, data: DataFrame, names, row_id: str, label: str, positive,
                           score_column: str = "probability", seed: int = 0) -> DataFrame:
    """Drop of the ROC area when one feature takes the values of other rows, raw and from 0 to 100.

    `data` should be rows the model was not fitted on. Two seeded hash ranks pair every row with a donor row: the join on rank is a random
    permutation of the table. One pass then scores each row once per feature, with only
    that feature taken from the donor.
    """
    names = list(names)
    spots = hash_rank(data.select(row_id, label, *names), [row_id], seed=seed, name="_spot")
    donors = hash_rank(data.select(row_id, *names), [row_id], seed=seed + 1, name="_spot").select(
        "_spot", *[F.col(c).alias(f"_donor_{c}") for c in names])
    paired = spots.join(donors, "_spot")
    features = F.explode(F.array(*[F.lit(n) for n in ["", *names]]))
    mixed = paired.withColumn("feature_name", features).select(
        "feature_name", label,
        *[F.when(F.col("feature_name") == c, F.col(f"_donor_{c}")).otherwise(F.col(c)).alias(c) for c in names])
    scored = model.transform(mixed).select("feature_name", label, score_expression(score_column).alias("score"))
    areas = auc(scored, label, "score", positive, ["feature_name"])
    base = areas.filter(F.col("feature_name") == "").select("auc").scalar()
    drops = areas.filter(F.col("feature_name") != "").select("feature_name", (base - F.col("auc")).alias("importance"))
    return spread_to_100(stage(drops, "drops"))


def feature_levels(spark: SparkSession) -> DataFrame:
    rows = [(n, "Gene level") for n in GENE_FEATURES] + [(n, "Mutation level") for n in VARIANT_SCORES]
    return spark.createDataFrame(rows, "feature_name string, feature_category string")


def with_feature_level(importance: DataFrame, levels: DataFrame) -> DataFrame:
    """Tag each feature as gene or mutation level; the latter is the default."""
    joined = importance.join(levels, "feature_name", "left")
    return joined.withColumn("feature_category", F.coalesce("feature_category", F.lit("Mutation level")))


def stack(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn(tag, F.lit(n)) for n, f in frames.items()])
