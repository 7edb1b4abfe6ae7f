"""Joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.session import stage


def merge(x: DataFrame, y: DataFrame, by_x, by_y=None, how: str = "inner",
          suffixes: tuple[str, str] = ("_x", "_y"), match_missing: bool = True) -> DataFrame:
    """Join on keys that may be named differently on each side.

    The key columns come first under the left names, then the rest of `x` and of `y`;
    names on both sides get the suffixes. With `match_missing` a missing key equals a
    missing key.
    """
    by_x = [by_x] if isinstance(by_x, str) else list(by_x)
    by_y = by_x if by_y is None else [by_y] if isinstance(by_y, str) else list(by_y)
    rest_x = [c for c in x.columns if c not in by_x]
    rest_y = [c for c in y.columns if c not in by_y]
    shared = set(rest_x) & set(rest_y)
    left = x.select(*by_x, *[F.col(c).alias(c + suffixes[0] if c in shared else c) for c in rest_x])
    right = y.select(
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(by_y)],
        *[F.col(c).alias(c + suffixes[1] if c in shared else c) for c in rest_y],
    )
    pairs = [(left[k], right[f"_key{i}"]) for i, k in enumerate(by_x)]
    tests = [a.eqNullSafe(b) if match_missing else a == b for a, b in pairs]
    joined = left.join(right, reduce(lambda a, b: a & b, tests), how)
    return joined.drop(*[f"_key{i}" for i in range(len(by_y))])


def spread_join(left: DataFrame, right: DataFrame, key, right_key, how: str = "inner") -> DataFrame:
    """Join with a table of few rows per key (a column or several), whatever share of `left` one key holds.

    The right side is written first. Spark then knows its size and broadcasts it only below
    its own threshold; otherwise both sides are shuffled for this join alone, which is when
    it splits the partitions of hot keys, equal rows included. The right key is not kept.
    """
    keys, right_keys = ([k] if isinstance(k, str) else list(k) for k in (key, right_key))
    named = {k: f"_key{i}" for i, k in enumerate(right_keys)}
    right = stage(right.withColumnsRenamed(named), "right")
    same = [F.col(k) == F.col(named[r]) for k, r in zip(keys, right_keys, strict=True)]
    return left.join(right, reduce(lambda a, b: a & b, same), how).drop(*named.values())


def natural_join(x: DataFrame, y: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every shared column name; missing matches missing."""
    shared = [c for c in x.columns if c in set(y.columns)]
    return merge(x, y, shared, how=how)


def map_both_ends(edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """Look both ends of an edge up in one map; an end with two ids yields two edges."""
    first = id_map.select(F.col("From").alias("P1"), F.col("To").alias("p1_id"))
    second = id_map.select(F.col("From").alias("P2"), F.col("To").alias("p2_id"))
    return edges.join(first, "P1").join(second, "P2").select("P1", "P2", "p1_id", "p2_id")


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, how: str = "left") -> DataFrame:
    """Add the columns of a lookup table."""
    return merge(df, table, key, table_key, how=how, match_missing=False)


def with_membership(df: DataFrame, column: str, members: DataFrame, member: str, target: str) -> DataFrame:
    """1 where the value occurs in `members`, else 0."""
    known = members.select(F.col(member).alias("_member")).distinct().withColumn("_hit", F.lit(1))
    joined = spread_join(df, known, column, "_member", "left")
    return joined.withColumn(target, F.coalesce("_hit", F.lit(0))).drop("_hit")


def drop_listed(df: DataFrame, listed: DataFrame, keys) -> DataFrame:
    """Rows whose keys are not in `listed`."""
    return df.join(listed.select(*keys), list(keys), "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()
