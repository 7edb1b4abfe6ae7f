"""Distinct, frequencies, degree and other aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonloom.catalog.registry import STEPS, query
from codonloom.catalog.views import RANKS
from codonloom.functions.numeric import row_mean
from codonloom.operators import graph, summarize
from codonloom.operators.scores import numeric_scores, variant_scores

# Both ends of each distinct edge mapped to gene ids, self pairs removed before mapping.
STEPS["mapped_edges"] = """
    select distinct a.to_id as p1_id, b.to_id as p2_id from edges e
    join id_map a on e.P1 = a.from_id join id_map b on e.P2 = b.from_id where coalesce(e.P1 <> e.P2, true)"""
STEPS["gene_pairs"] = "select distinct p2_id as gene, p1_id as partner from mapped_edges"
STEPS["gene_degree"] = "select gene, count(*) as times from gene_pairs group by gene"


def score_steps(source: str, result: str, ranks) -> None:
    """Steps from the score rows of a source to one row per variant, named after `result`."""
    STEPS[f"parsed_{result}"] = r"""
    select Uploaded_variation, try_cast(SIFT as double) as SIFT,
      try_cast(regexp_replace(PolyPhen, '.*\((.*)\).*', '\1') as double) as PolyPhen,
      try_cast(Condel as double) as Condel, """ + ", ".join(f"try_cast({r} as double) as {r}" for r in ranks) + f" from {source}"
    STEPS[f"top_{result}"] = "select Uploaded_variation, " + ", ".join(
        f"max({c}) as {c}" for c in ("SIFT", "PolyPhen", "Condel", *ranks)) + f" from parsed_{result} group by Uploaded_variation"
    STEPS[result] = f"""
    select Uploaded_variation, SIFT as sift, PolyPhen as polyphen, Condel as condel,
      ({' + '.join(f'coalesce({r}, 0)' for r in ranks)}) /
      nullif({' + '.join(f'({r} is not null)::int' for r in ranks)}, 0) as average_rank from top_{result}"""


score_steps("score_rows", "variant_level", RANKS)
# Names under which the texts below know them.
STEPS["parsed_scores"], STEPS["top_scores"] = STEPS["parsed_variant_level"], STEPS["top_variant_level"].replace("parsed_variant_level", "parsed_scores")


def pairs(t):
    return graph.interaction_pairs(t("edges"), t("id_map"))


@query("distinct_rows", "select distinct P1, P2 from edges")
def _(t):
    return t("edges").distinct()


@query("distinct_values", "select distinct SWISSPROT from mutations")
def _(t):
    return summarize.distinct_values(t("mutations"), "SWISSPROT")


@query("distinct_count", "select count(distinct SWISSPROT) as n_proteins from mutations")
def _(t):
    return summarize.distinct_count(t("mutations"), "SWISSPROT", "n_proteins")


@query("duplicate_check", """
    select cast(sum(c) as bigint) as n_rows, count(*) as n_distinct, cast(sum(c) - count(*) as bigint) as n_duplicates
    from (select count(*) as c from edges group by P1, P2)""")
def _(t):
    return summarize.duplicate_check(t("edges"))


@query("frequency_table", """
    select Variant_Type, count(*) as freq from mutations where Variant_Type is not null group by Variant_Type""")
def _(t):
    return summarize.frequencies(t("mutations"), "Variant_Type")


@query("frequency_total", "select count(Variant_Type) as total from mutations")
def _(t):
    return summarize.frequency_total(summarize.frequencies(t("mutations"), "Variant_Type"))


@query("class_balance", "select class, count(*) as n from labelled_docs group by class")
def _(t):
    return summarize.class_balance(t("labelled_docs"), "class")


_PARTS = """
    select gene, part, string_agg(cast(partner as varchar), ',' order by partner) as members, max(times) as times
    from (select gene, partner, count(*) over (partition by gene) as times, cast((row_number() over (
        partition by gene order by md5('0|' || cast(partner as varchar)), partner) - 1) // {size} as int) as part
      from gene_pairs) group by gene, part"""


@query("partner_strings", _PARTS.format(size=10_000))
def _(t):
    return graph.partner_strings(pairs(t))


@query("partner_strings_in_parts", _PARTS.format(size=3))
def _(t):
    return graph.partner_strings(pairs(t), 3)


@query("interaction_degree", "select gene, times from gene_degree")
def _(t):
    return graph.degree(pairs(t))


@query("interaction_degree_p1", "select p1_id as gene, count(distinct p2_id) as times from mapped_edges group by p1_id")
def _(t):
    return graph.degree(graph.interaction_pairs(t("edges"), t("id_map"), "p1"))


@query("interaction_degree_both", """
    select gene, count(*) as times from (select p1_id as gene, p2_id as partner from mapped_edges
      union select p2_id, p1_id from mapped_edges) group by gene""")
def _(t):
    return graph.degree(graph.interaction_pairs(t("edges"), t("id_map"), "both"))


@query("max_per_variant", f"select Uploaded_variation, {', '.join(('SIFT', 'PolyPhen', 'Condel', *RANKS))} from top_scores")
def _(t):
    columns = ("SIFT", "PolyPhen", "Condel", *RANKS)
    return summarize.max_per_key(numeric_scores(t("score_rows"), columns), "Uploaded_variation", columns)


@query("mean_rank_per_row", f"""
    select Uploaded_variation, round(({' + '.join(f'coalesce({r}, 0)' for r in RANKS)}) /
      nullif({' + '.join(f'({r} is not null)::int' for r in RANKS)}, 0), 6) as average_rank from parsed_scores""")
def _(t):
    return numeric_scores(t("score_rows"), RANKS).select(
        "Uploaded_variation", F.round(row_mean(RANKS), 6).alias("average_rank"))


@query("variant_scores", """
    select Uploaded_variation, sift, polyphen, condel, round(average_rank, 6) as average_rank from variant_level""")
def _(t):
    return variant_scores(t("score_rows")).withColumn("average_rank", F.round("average_rank", 6))


@query("column_deviations", """
    select round(stddev_samp(l_quantity), 6) as l_quantity, round(stddev_samp(l_discount), 6) as l_discount,
      round(stddev_samp(l_tax), 6) as l_tax from lineitem""")
def _(t):
    columns = ["l_quantity", "l_discount", "l_tax"]
    return summarize.deviations(t("lineitem"), columns).select(*[F.round(c, 6).alias(c) for c in columns])


_SUMMARY = """select '{c}' as "column", count({c}) as n, count(*) - count({c}) as n_missing, min({c}) as minimum,
    quantile_disc({c}, 0.25) as q1, quantile_disc({c}, 0.5) as median, quantile_disc({c}, 0.75) as q3,
    round(avg({c}), 6) as mean, max({c}) as maximum from parsed_scores"""


@query("column_summary", " union all ".join(_SUMMARY.format(c=c) for c in ("SIFT", "PolyPhen", "Condel")))
def _(t):
    columns = ("SIFT", "PolyPhen", "Condel")
    summary = summarize.numeric_summary(numeric_scores(t("score_rows"), columns), columns)
    return summary.select("column", "n", "n_missing", "minimum", "q1", "median", "q3", F.round("mean", 6).alias("mean"), "maximum")
