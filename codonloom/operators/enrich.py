"""Over-representation of gene sets in groups of genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonloom.functions.numeric import hypergeometric_tail
from codonloom.functions.text import drop_prefix

TERM_PREFIX = len("HALLMARK_")


def term_sizes(sets: DataFrame, smallest: int = 20, largest: int = 500) -> DataFrame:
    """Terms whose number of genes lies within the bounds."""
    sizes = sets.select("term", "gene").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("m_term"))
    return sizes.filter(F.col("m_term").between(smallest, largest))


def overlaps(groups: DataFrame, sets: DataFrame, smallest: int = 20, largest: int = 500) -> DataFrame:
    """Counts behind the test for each (group, term) with at least one common gene.

    `k` common genes, `n_query` genes of the group in the universe, `m_term` genes of the
    term, `n_universe` genes in the library (taken before the size filter). One join of
    the long tables serves all of them: every library gene also carries one row without
    a term, and the count of those rows per group is `n_query`. `groups` holds distinct
    (group, gene) rows.
    """
    pairs = sets.select("term", "gene").distinct()
    tested = pairs.join(term_sizes(sets, smallest, largest), "term").select("gene", "term", "m_term")
    universe = pairs.select("gene").distinct()
    members = universe.select("gene", F.lit(None).cast("string").alias("term"),
                              F.lit(None).cast("bigint").alias("m_term"))
    library = tested.unionByName(members)
    hits = (
        groups.select("group", "gene").join(library, "gene")
        .groupBy("group", "term", "m_term").agg(F.count(F.lit(1)).alias("k"))
    )
    n_query = F.max(F.when(F.col("term").isNull(), F.col("k"))).over(Window.partitionBy("group"))
    n_universe = universe.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        hits.withColumn("n_query", n_query).filter(F.col("term").isNotNull())
        .select("group", "term", "k", "n_query", "m_term", n_universe.alias("n_universe"))
    )


def adjust_p(df: DataFrame, by: str = "group", p: str = "p", order: str = "term",
             turn: float = 0.5) -> DataFrame:
    """Benjamini-Hochberg `p_adj` and fixed-lambda Storey `q` within each group.

    A group has at most one row per term, so its window is bounded by the library. `turn`
    is the lambda beyond which p-values are taken as null.
    """
    group = Window.partitionBy(by)
    downward = group.orderBy(F.desc(p), F.desc(order))
    sofar = downward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = F.count(F.lit(1)).over(group)
    ranked = df.withColumns({
        "_m": m, "_rank": m - F.row_number().over(downward) + 1,
        "_pi0": F.least(F.lit(1.0), F.avg((F.col(p) >= turn).cast("double")).over(group) / (1 - turn)),
    })
    adjusted = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(sofar))
    return (
        ranked.withColumn("p_adj", adjusted).withColumn("q", F.col("_pi0") * F.col("p_adj"))
        .drop("_m", "_rank", "_pi0")
    )


def enrichment(groups: DataFrame, sets: DataFrame, smallest: int = 20, largest: int = 500,
               adjusted: bool = True) -> DataFrame:
    """Hypergeometric test of every (group, term), with adjusted p and q."""
    counts = overlaps(groups, sets, smallest, largest)
    tested = counts.withColumn("p", hypergeometric_tail("k", "n_query", "m_term", "n_universe"))
    return adjust_p(tested) if adjusted else tested


def significant(results: DataFrame, p: float = 0.05, q: float = 0.05) -> DataFrame:
    """Results within all three cut-offs."""
    return results.filter((F.col("p") <= p) & (F.col("p_adj") <= p) & (F.col("q") <= q))


def best_terms(groups: DataFrame, results: DataFrame) -> DataFrame:
    """The term with the smallest p per group, ties by name; null where none was tested."""
    best = results.groupBy("group").agg(F.min_by("term", F.struct("p", "term")).alias("term"))
    return groups.select("group").distinct().join(best, "group", "left")


def term_categories(best: DataFrame, categories: DataFrame) -> DataFrame:
    """Category of each group's best term after stripping the library prefix."""
    named = best.withColumn("Hallmark_name", drop_prefix("term", TERM_PREFIX))
    return named.join(categories, "Hallmark_name", "left")


def unmatched_terms(sets: DataFrame, categories: DataFrame) -> DataFrame:
    """Library terms the category lookup does not know."""
    terms = sets.select("term").distinct().withColumn("Hallmark_name", drop_prefix("term", TERM_PREFIX))
    return terms.join(categories, "Hallmark_name", "left_anti").select("term")
