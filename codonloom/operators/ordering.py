"""Sorts, ranks and running sums that never hold one whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_columns, seed: int = 0) -> Column:
    """A seeded order over row ids that any engine can reproduce."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in id_columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_rank(df: DataFrame, id_columns, by=(), seed: int = 0, name: str = "rank",
              digits: int = 3) -> DataFrame:
    """Number rows 1..n in seeded hash order, within each `by` group.

    The leading hash digits cut every group, however large, into 16**digits even slices.
    Slice sizes give each slice its starting rank; rows are then numbered inside their
    slice only. Both steps use the same partitioning, so rows move once. `by` columns
    must not be null.
    """
    by = list(by)
    hashed = df.withColumn("_hash", hash_order(id_columns, seed)).withColumn(
        "_slice", F.substring("_hash", 1, digits))
    sizes = hashed.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_slice").orderBy("_hash", *id_columns)
    return (
        hashed.join(starts, [*by, "_slice"])
        .withColumn(name, (F.col("_start") + F.row_number().over(inside)).cast("long"))
        .select(*df.columns, name)
    )


def running_sums(df: DataFrame, order: str, sums: dict[str, str], by=(), slices: int = 128) -> DataFrame:
    """Running totals from the largest to the smallest value of a numeric column.

    `sums` maps output names to summed columns; `total_<name>` carries the group total.
    `df` holds each order value once per group. Quantiles of the order column cut the
    series into slices of similar size, slice totals give the carry-in, and the running
    window stays inside a slice. `by` columns must not be null.
    """
    by = list(by)
    cuts = [i / slices for i in range(1, slices)]
    edges = df.agg(F.percentile_approx(order, cuts, 10000).alias("edges")).scalar()
    # Never null, or the join below would have the slice computed for every input row.
    above_edges = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(order))), F.lit(0))
    sliced = df.withColumn("_edges", edges).withColumn("_slice", above_edges).drop("_edges")
    totals = sliced.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    above = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    carried = totals.select(
        *by, "_slice",
        *[F.coalesce(F.sum(f"_{n}").over(above), F.lit(0)).alias(f"_carry_{n}") for n in sums],
        *[F.sum(f"_{n}").over(whole).alias(f"total_{n}") for n in sums],
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(F.desc(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return sliced.join(carried, [*by, "_slice"]).select(
        *df.columns,
        *[(F.col(f"_carry_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()],
        *[F.col(f"total_{n}") for n in sums],
    )


def sort_rows(df: DataFrame, *keys) -> DataFrame:
    """Global sort that can spread rows with equal keys over several tasks.

    A range partition cannot split equal keys, so a row number from the input partitions
    is the last key.
    """
    return (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .orderBy(*keys, "_tie").drop("_tie")
    )


def sort_by_degree(df: DataFrame, degree: str = "times", partners: str = "P2_entrez") -> DataFrame:
    return sort_rows(df, F.desc(degree), F.asc(partners))


def sort_genomic(df: DataFrame) -> DataFrame:
    """Chromosome sorts as text."""
    return sort_rows(df, "Chromosome", "Start_Position", "End_Position")


def sort_by_importance(df: DataFrame, importance: str = "overall", name: str = "feature_name") -> DataFrame:
    return sort_rows(df, F.desc(importance), F.asc(name))


def top_rows(df: DataFrame, n: int, *keys) -> DataFrame:
    """The first `n` rows of the sorted table (each task keeps `n`, then they merge)."""
    return df.orderBy(*keys).limit(n)


def first_per_key(df: DataFrame, keys, *order) -> DataFrame:
    """One row per key, the first in `order`; partial minima are merged, not sorted."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
