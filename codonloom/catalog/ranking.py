"""Sorts, top rows and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonloom.catalog.counting import pairs
from codonloom.catalog.registry import query
from codonloom.operators import graph, ordering
from codonloom.operators.enrich import adjust_p
from codonloom.plans.assemble import annotation_request, first_accession

# A p-value-like number per part and supplier nation: few rows per group, with ties.
_TESTS = """select n_name as "group", 'T' || cast(p_partkey as varchar) as term, (p_partkey * 7919 % 1000 + 1) / 1001 as p
    from part join nation on p_partkey % 25 = n_nationkey"""


def _tests(t):
    joined = t("part").join(t("nation"), F.expr("p_partkey % 25 = n_nationkey"))
    return joined.select(
        F.col("n_name").alias("group"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("term"),
        F.expr("(p_partkey * 7919 % 1000 + 1) / 1001").cast("double").alias("p"))


@query("sort_by_degree", "select gene, times from gene_degree order by times desc, gene")
def _(t):
    return ordering.sort_by_degree(graph.degree(pairs(t)), "times", "gene")


@query("sort_genomic", """
    select distinct Chromosome, Start_Position, End_Position, Reference_Allele || '/' || Tumor_Seq_Allele2 as allele, Strand
    from mutations""")
def _(t):
    return annotation_request(t("mutations"))


@query("top_genes", "select gene, times from gene_degree order by times desc, gene limit 10")
def _(t):
    return ordering.top_rows(graph.degree(pairs(t)), 10, F.desc("times"), F.asc("gene"))


@query("top_row_per_group", """
    select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey
      order by o_totalprice desc, o_orderkey) as nth from orders) where nth = 1""")
def _(t):
    orders = t("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordering.first_per_key(orders, ["o_custkey"], -F.col("o_totalprice"), "o_orderkey")


@query("first_accession_per_symbol", """
    select symbol, Entry from (select *, row_number() over (partition by symbol order by row_no) as nth from protein_rows)
    where nth = 1""")
def _(t):
    return first_accession(t("protein_rows"))


@query("adjusted_p_values", f"""
    with tests as ({_TESTS}),
    ranked as (select *, count(*) over (partition by "group") as m,
      row_number() over (partition by "group" order by p, term) as nth,
      avg(case when p >= 0.5 then 1.0 else 0.0 end) over (partition by "group") as share from tests),
    adjusted as (select *, least(1, min(p * m / nth) over (partition by "group" order by p desc, term desc
      rows between unbounded preceding and current row)) as p_adj from ranked)
    select "group", term, round(p, 9) as p, round(p_adj, 9) as p_adj, round(least(1, share / 0.5) * p_adj, 9) as q from adjusted""")
def _(t):
    adjusted = adjust_p(_tests(t))
    return adjusted.select("group", "term", *[F.round(c, 9).alias(c) for c in ("p", "p_adj", "q")])


@query("rank_in_hash_order", """
    select o_orderkey, row_number() over (order by md5('0|' || cast(o_orderkey as varchar)), o_orderkey) as place from orders""")
def _(t):
    return ordering.hash_rank(t("orders").select("o_orderkey"), ["o_orderkey"], name="place")


@query("running_totals", """
    select score, n, cast(sum(n) over (order by score desc) as bigint) as upto
    from (select score, count(*) as n from predictions group by score)""")
def _(t):
    counts = t("predictions").groupBy("score").agg(F.count("*").alias("n"))
    return ordering.running_sums(counts, "score", {"upto": "n"}).select("score", "n", "upto")
