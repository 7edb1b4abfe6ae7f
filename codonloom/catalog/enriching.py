"""Gene-set enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonloom.catalog.counting import pairs
from codonloom.catalog.registry import STEPS, query
from codonloom.operators import enrich, graph
from codonloom.plans.assemble import process_flags
from codonloom.session import stage
from codonloom.sources.readers import gene_sets
from codonloom.sources.schemas import NO_CATEGORY, PROCESS_CATEGORIES, snake

STEPS["group_members"] = """
    select gene as grp, partner as gene from gene_pairs union select gene, gene from gene_pairs"""
STEPS["library_pairs"] = "select distinct gs_name as term, entrez_gene as gene from gene_library where gs_cat = 'H'"
STEPS["tested_terms"] = """
    select term, count(*) as m_term from library_pairs group by term having count(*) between 20 and 500"""
STEPS["group_overlaps"] = """
    with hits as (select g.grp, l.term, count(*) as k from group_members g join library_pairs l on g.gene = l.gene
      group by g.grp, l.term),
    sizes as (select g.grp, count(*) as n_query from group_members g
      join (select distinct gene from library_pairs) u on g.gene = u.gene group by g.grp)
    select h.grp, h.term, h.k, s.n_query, m.m_term, (select count(distinct gene) from library_pairs) as n_universe
    from hits h join tested_terms m on h.term = m.term join sizes s on h.grp = s.grp"""
# The upper tail as a plain sum of log-gamma terms.
STEPS["group_tests"] = """
    with steps as (select distinct k, n_query as n, m_term as m, n_universe as u from group_overlaps),
    terms as (select k, n, m, u, unnest(range(k, least(n, m) + 1)) as i from steps),
    tails as (select k, n, m, u, sum(case when n - i <= u - m then exp(
        lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(u - m + 1) - lgamma(n - i + 1) - lgamma(u - m - n + i + 1)
        - lgamma(u + 1) + lgamma(n + 1) + lgamma(u - n + 1)) else 0 end) as p from terms group by k, n, m, u)
    select o.*, least(1, t.p) as p from group_overlaps o
    join tails t on o.k = t.k and o.n_query = t.n and o.m_term = t.m and o.n_universe = t.u"""
STEPS["group_best"] = """
    with ranked as (select grp, term, row_number() over (partition by grp order by p, term) as nth from group_tests)
    select g.grp, r.term from (select distinct grp from group_members) g left join ranked r on g.grp = r.grp and r.nth = 1"""
STEPS["group_flags"] = "select b.grp, " + ", ".join(
    f"max(case when h.Process_category = '{c}' then 1 else 0 end) as {snake(c)}" for c in PROCESS_CATEGORIES
) + f""", max(case when h.Process_category is null then 1 else 0 end) as {NO_CATEGORY}
    from group_best b left join hallmarks h on substring(b.term, 10) = h.Hallmark_name group by b.grp"""


def _groups(t):
    return graph.query_groups(pairs(t))


def _sets(t):
    return gene_sets(t("gene_library"))


@query("query_groups", 'select grp as "group", gene from group_members')
def _(t):
    return _groups(t)


@query("term_size_filter", "select term, m_term from tested_terms")
def _(t):
    return enrich.term_sizes(_sets(t))


@query("group_term_overlaps", 'select grp as "group", term, k, n_query, m_term, n_universe from group_overlaps')
def _(t):
    return enrich.overlaps(_groups(t), _sets(t))


@query("hypergeometric_test", 'select grp as "group", term, k, round(p, 6) as p from group_tests')
def _(t):
    tested = enrich.enrichment(_groups(t), _sets(t), adjusted=False)
    return tested.select("group", "term", "k", F.round("p", 6).alias("p"))


_ADJUSTED = """
    with ranked as (select *, count(*) over (partition by grp) as m, row_number() over (partition by grp order by p, term) as nth,
      avg(case when p >= 0.5 then 1.0 else 0.0 end) over (partition by grp) as share from group_tests),
    adjusted as (select *, least(1, min(p * m / nth) over (partition by grp order by p desc, term desc
      rows between unbounded preceding and current row)) as p_adj from ranked),
    scored as (select *, least(1, share / 0.5) * p_adj as q from adjusted)
    """


@query("enrichment_adjusted", _ADJUSTED + """
    select grp as "group", term, round(p_adj, 6) as p_adj, round(q, 6) as q from scored""")
def _(t):
    tested = enrich.enrichment(_groups(t), _sets(t))
    return tested.select("group", "term", F.round("p_adj", 6).alias("p_adj"), F.round("q", 6).alias("q"))


@query("enrichment_significant", _ADJUSTED + """
    select grp as "group", term, k from scored where p <= 0.05 and p_adj <= 0.05 and q <= 0.05""")
def _(t):
    return enrich.significant(enrich.enrichment(_groups(t), _sets(t))).select("group", "term", "k")


@query("best_term_per_group", 'select grp as "group", term from group_best')
def _(t):
    groups = _groups(t)
    return enrich.best_terms(groups, enrich.enrichment(groups, _sets(t), adjusted=False))


@query("best_term_frequencies", "select term, count(*) as freq from group_best where term is not null group by term")
def _(t):
    groups = _groups(t)
    best = enrich.best_terms(groups, enrich.enrichment(groups, _sets(t), adjusted=False))
    return best.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("freq"))


@query("best_term_categories", """
    select b.grp as "group", substring(b.term, 10) as Hallmark_name, h.Process_category from group_best b
    left join hallmarks h on substring(b.term, 10) = h.Hallmark_name""")
def _(t):
    groups = _groups(t)
    best = enrich.best_terms(groups, enrich.enrichment(groups, _sets(t), adjusted=False))
    return enrich.term_categories(best, t("hallmarks")).select("group", "Hallmark_name", "Process_category")


@query("unmatched_terms", """
    select distinct term from library_pairs where substring(term, 10) not in (select Hallmark_name from hallmarks)""")
def _(t):
    return enrich.unmatched_terms(_sets(t), t("hallmarks"))


@query("process_flags", 'select grp as "group", * exclude (grp) from group_flags')
def _(t):
    return process_flags(stage(pairs(t), "pairs"), _sets(t), t("hallmarks"))
