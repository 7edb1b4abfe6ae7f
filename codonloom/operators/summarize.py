"""Counts, totals and per-key aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonloom.functions.numeric import finite
from codonloom.operators.ordering import hash_rank, running_sums
from codonloom.session import stage


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def distinct_count(df: DataFrame, column: str, name: str = "n_distinct") -> DataFrame:
    return df.agg(F.count_distinct(column).alias(name))


def duplicate_check(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and their difference, in one row."""
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_times"))
    total = F.coalesce(F.sum("_times"), F.lit(0))
    return per_row.agg(
        total.alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
        (total - F.count(F.lit(1))).alias("n_duplicates"),
    )


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; missing values are not counted."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("freq"))


def frequency_total(freq: DataFrame) -> DataFrame:
    return freq.agg(F.sum("freq").alias("total"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def member_strings(pairs: DataFrame, key: str, member: str, part_size: int = 10_000) -> DataFrame:
    """Members of each key as sorted, comma-joined texts, with the group size.

    Members are numbered in hash order within their key, and every `part_size` of them make
    one row (`part` 0, 1, ...). The rule is the same for groups of any size, so a hub never
    has to fit one row or one task and no member is left out.
    """
    unique = pairs.select(key, member).distinct()
    ranked = hash_rank(unique, [member], by=[key], name="_nth")
    spread = ranked.withColumn("part", F.floor((F.col("_nth") - 1) / part_size).cast("int"))
    joined = F.array_join(F.array_sort(F.collect_list(member)).cast("array<string>"), ",")
    texts = spread.groupBy(key, "part").agg(F.count(F.lit(1)).alias("_n"), joined.alias("members"))
    # One row per part by now.
    return texts.select(key, "part", F.sum("_n").over(Window.partitionBy(key)).alias("times"), "members")


def max_per_key(df: DataFrame, key: str, columns) -> DataFrame:
    """Largest present value of every column per key."""
    return df.groupBy(key).agg(*[F.max(c).alias(c) for c in columns])


def nullify_nonfinite(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def deviations(df: DataFrame, columns) -> DataFrame:
    """Sample standard deviation of every column, in one row."""
    return df.agg(*[F.stddev_samp(c).alias(c) for c in columns])


def numeric_summary(df: DataFrame, columns) -> DataFrame:
    """Per column: present and missing values, minimum, quartiles, mean, maximum.

    Quartiles are exact: the smallest value with at least a quarter, half or three quarters
    of the present values up to it, found by running sums over counts per value.
    """
    columns = list(columns)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    table = long.groupBy("column").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.min("value").alias("minimum"), F.avg("value").alias("mean"), F.max("value").alias("maximum"))
    present = long.filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("times"))
    running = running_sums(stage(present, "value_counts"), "value", {"down": "times"}, ["column"])
    upto = F.col("total_down") - F.col("down") + F.col("times")
    quartiles = running.groupBy("column").agg(*[
        F.min(F.when(4 * upto >= i * F.col("total_down"), F.col("value"))).alias(name)
        for i, name in enumerate(("q1", "median", "q3"), 1)])
    return table.join(quartiles, "column", "left").select(
        "column", "n", "n_missing", "minimum", "q1", "median", "q3", "mean", "maximum")
