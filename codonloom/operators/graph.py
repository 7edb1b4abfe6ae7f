"""Interaction graph as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.operators.clean import without_self_pairs
from codonloom.operators.relate import map_both_ends
from codonloom.operators.summarize import member_strings


def interaction_pairs(edges: DataFrame, id_map: DataFrame, direction: str = "p2") -> DataFrame:
    """Distinct (gene, partner) pairs after mapping both ends of each edge.

    `direction` names the end that owns the pair: ``p2`` counts the P1 partners of the P2
    end, ``p1`` the reverse, ``both`` takes each edge both ways. Self pairs are removed
    before mapping, so two proteins of one gene still give that gene a self pair. The
    distinct after mapping also covers repeated edges, so the edges move only once.
    """
    ids = map_both_ends(without_self_pairs(edges.select("P1", "P2")), id_map)
    of_p2 = ids.select(F.col("p2_id").alias("gene"), F.col("p1_id").alias("partner"))
    of_p1 = ids.select(F.col("p1_id").alias("gene"), F.col("p2_id").alias("partner"))
    pairs = {"p2": of_p2, "p1": of_p1}.get(direction)
    if pairs is None:
        pairs = of_p2.unionByName(of_p1)
    return pairs.distinct()


def degree(pairs: DataFrame) -> DataFrame:
    """Number of partners per gene, counted without building partner lists."""
    return pairs.groupBy("gene").agg(F.count(F.lit(1)).alias("times"))


def partner_strings(pairs: DataFrame, part_size: int = 10_000) -> DataFrame:
    """Partner list per gene as text, for export."""
    return member_strings(pairs, "gene", "partner", part_size)


def query_groups(pairs: DataFrame) -> DataFrame:
    """(group, gene) rows: each gene together with all of its partners.

    Pairs are distinct already, so only a pair of a gene with itself could repeat the
    gene's own row.
    """
    partners = pairs.filter(F.col("gene") != F.col("partner")).select(
        F.col("gene").alias("group"), F.col("partner").alias("gene"))
    own = pairs.select("gene").distinct().select(F.col("gene").alias("group"), "gene")
    return partners.unionByName(own)
