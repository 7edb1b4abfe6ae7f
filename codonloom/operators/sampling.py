"""Class balancing and folds, decided by a hash of the row id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonloom.operators.ordering import hash_order, hash_rank

CLASSES = ("driver", "passenger")
_DIGITS = 4


def undersample(df: DataFrame, label: str, id_columns, levels=CLASSES, seed: int = 0) -> DataFrame:
    """Keep as many rows of each class as the smallest class has.

    The rows kept are those with the lowest seeded hash of their (unique) id. A histogram
    over the leading hash digits finds, per class, the slice in which the last kept row
    lies; ranking that slice alone finds the last kept hash. Both passes read ids and
    labels only, and the full rows are then filtered without moving. The cut tables have
    one row per entry of `levels`, which is what bounds the broadcasts.
    """
    ids = list(id_columns)
    rows = df.filter(F.col(label).isin(*levels)).withColumn("_hash", hash_order(ids, seed))
    kept = rows.join(F.broadcast(_last_kept(rows, label, ids)), label).filter(F.struct("_hash", *ids) <= F.col("_last"))
    return kept.select(*df.columns)


def mark_undersample(df: DataFrame, label: str, id_columns, levels=CLASSES, seed: int = 0, name: str = "kept") -> DataFrame:
    """All rows, with a flag for those that `undersample` keeps; they do not move either."""
    ids = list(id_columns)
    rows = df.withColumn("_hash", hash_order(ids, seed))
    last = _last_kept(rows.filter(F.col(label).isin(*levels)), label, ids)
    inside = F.coalesce(F.struct("_hash", *ids) <= F.col("_last"), F.lit(False))
    return rows.join(F.broadcast(last), label, "left").withColumn(name, inside).select(*df.columns, name)


def _last_kept(rows: DataFrame, label: str, ids: list[str]) -> DataFrame:
    """Hash and id of the last row of each class that undersampling keeps."""
    keys = rows.select(label, *ids, "_hash", F.substring("_hash", 1, _DIGITS).alias("_slice"))
    sizes = keys.groupBy(label, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    smallest = sizes.groupBy(label).agg(F.sum("_size").alias("_n")).agg(F.min("_n").alias("n")).scalar()
    upto = F.sum("_size").over(Window.partitionBy(label).orderBy("_slice"))
    slices = (
        sizes.withColumn("_upto", upto).withColumn("_keep", smallest)
        .filter(F.col("_upto") >= F.col("_keep"))
        .groupBy(label).agg(
            F.min("_slice").alias("_slice"),
            F.min_by(F.col("_keep") - F.col("_upto") + F.col("_size"), F.col("_slice")).alias("_need"),
        )
    )
    order = Window.partitionBy(label).orderBy("_hash", *ids)
    return (
        keys.join(F.broadcast(slices), [label, "_slice"])
        .withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") == F.col("_need"))
        .select(label, F.struct("_hash", *ids).alias("_last"))
    )


def stratified_fraction(df: DataFrame, label: str, id_columns, fraction: float, levels=CLASSES,
                        seed: int = 0) -> DataFrame:
    """The rounded `fraction` of each class, exactly."""
    rows = df.filter(F.col(label).isin(*levels))
    ranked = hash_rank(rows, id_columns, by=[label], seed=seed, name="_nth")
    quotas = rows.groupBy(label).agg(F.bround(F.count(F.lit(1)) * F.lit(fraction)).alias("_quota"))
    # One row per entry of `levels`.
    return ranked.join(F.broadcast(quotas), label).filter(F.col("_nth") <= F.col("_quota")).select(*df.columns)


def assign_folds(df: DataFrame, label: str, id_columns, k: int = 10, seed: int = 0,
                 name: str = "fold") -> DataFrame:
    """Stratified folds 0..k-1 whose class counts differ by at most one row."""
    ranked = hash_rank(df, id_columns, by=[label], seed=seed, name="_nth")
    return ranked.withColumn(name, F.pmod(F.col("_nth") - 1, F.lit(k)).cast("int")).drop("_nth")
