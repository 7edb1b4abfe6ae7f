"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.session import scratch_scope, stage


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(`node`, `component`): the smallest node reachable, for every node with an edge to another.

    Alternating star contractions: every node first ties its larger neighbours, then its
    smaller ones, to the smallest node next to it, until nothing changes. Each round is
    written to the shared folder, so a lost executor costs one round at most, and deleted
    once the next round is there; the minimum per node is written as well, which leaves hubs
    to Spark's skew splitting in the join. Null ends and self edges are left out; repeated
    edges count once.
    """
    spark = edges.sparkSession
    with scratch_scope(spark) as all_rounds:
        ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
        now = stage(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        seen = None
        while (digest := _digest(now)) != seen:
            seen = digest
            before, all_rounds.paths = all_rounds.paths, []
            with scratch_scope(spark) as one_round:
                both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
                least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
                large = both.join(stage(least, "least"), F.col("a") == F.col("k")).filter("b > a").select(
                    F.col("b").alias("a"), F.col("m").alias("b"))
                large = stage(large.distinct(), "large")
                down = stage(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"), "down")
                small = large.join(down, F.col("a") == F.col("k")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                now = one_round.keep(small.unionByName(down.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
            now_paths, all_rounds.paths = all_rounds.paths, before
            all_rounds.drop()
            all_rounds.paths = now_paths
        roots = now.select("b").distinct()
        return all_rounds.keep(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
            roots.select(F.col("b").alias("node"), F.col("b").alias("component"))), "components")
