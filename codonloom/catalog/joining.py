"""Joins, unions and exclusions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonloom.catalog.registry import query
from codonloom.operators import relate
from codonloom.operators.labels import codon_labels, label_by_codon, with_codon_key
from codonloom.operators.clean import split_protein_change


@query("join_inner_renamed_key", """
    select o_orderkey, o_totalprice, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey""")
def _(t):
    orders = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    return relate.merge(orders, customers, "o_custkey", "c_custkey", match_missing=False).drop("o_custkey")


@query("join_inner_same_key", """
    select l.doc_id, l.quality, l.toxic, d.lang, d.n_chars from labels l join documents d on l.doc_id = d.doc_id""")
def _(t):
    return relate.merge(t("labels"), t("documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query("join_left", """
    select d.doc_id, d.lang, l.quality from documents d left join labels l on d.doc_id = l.doc_id""")
def _(t):
    return relate.merge(t("documents").select("doc_id", "lang"), t("labels").select("doc_id", "quality"), "doc_id", how="left")


@query("join_natural_null_safe", """
    with x as (select distinct query, entrezgene from symbols),
    y as (select query, entrezgene, count(*) as n from symbols group by query, entrezgene)
    select x.query, x.entrezgene, y.n from x join y on x.query = y.query and x.entrezgene is not distinct from y.entrezgene""")
def _(t):
    symbols = t("symbols").select("query", "entrezgene")
    counts = symbols.groupBy("query", "entrezgene").agg(F.count("*").alias("n"))
    return relate.natural_join(symbols.distinct(), counts)


@query("join_multi_key", """
    with v as (select distinct Chromosome, Start_Position, Reference_Allele, Tumor_Seq_Allele2 from mutations),
    s as (select l_partkey, l_suppkey, max(l_extendedprice) as top_price from lineitem group by l_partkey, l_suppkey)
    select v.*, s.top_price from v join s on v.Chromosome = cast(s.l_partkey % 22 + 1 as varchar)
      and v.Start_Position = s.l_partkey * 100 + s.l_suppkey % 10
      and v.Reference_Allele = substring('ACGT', cast(s.l_partkey % 4 as int) + 1, 1)
      and v.Tumor_Seq_Allele2 = substring('ACGT', cast((s.l_partkey + 1 + s.l_suppkey % 3) % 4 as int) + 1, 1)""")
def _(t):
    variants = t("mutations").select(
        "Chromosome", "Start_Position", "Reference_Allele", "Tumor_Seq_Allele2").distinct()
    sites = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("top_price")).selectExpr(
        "cast(l_partkey % 22 + 1 as string) as Chrom", "l_partkey * 100 + l_suppkey % 10 as Position",
        "substring('ACGT', cast(l_partkey % 4 as int) + 1, 1) as Ref_Base",
        "substring('ACGT', cast((l_partkey + 1 + l_suppkey % 3) % 4 as int) + 1, 1) as Alt_Base", "top_price")
    return relate.merge(
        variants, sites, ["Chromosome", "Start_Position", "Reference_Allele", "Tumor_Seq_Allele2"],
        ["Chrom", "Position", "Ref_Base", "Alt_Base"], match_missing=False)


@query("join_both_ends", """
    select e.P1, e.P2, a.to_id as p1_id, b.to_id as p2_id
    from (select distinct P1, P2 from edges) e join id_map a on e.P1 = a.from_id join id_map b on e.P2 = b.from_id""")
def _(t):
    return relate.map_both_ends(t("edges").distinct(), t("id_map"))


@query("join_lookup", """
    select g.gs_name, g.entrez_gene, h.Process_category from gene_library g
    left join hallmarks h on substring(g.gs_name, 10) = h.Hallmark_name""")
def _(t):
    library = t("gene_library").select("gs_name", "entrez_gene", F.expr("substring(gs_name, 10)").alias("short"))
    categories = t("hallmarks").select("Hallmark_name", "Process_category")
    return relate.lookup(library, categories, "short", "Hallmark_name").drop("short")


@query("join_suffixed_columns", """
    select a.doc_id, a.n as n_x, b.n as n_y from (select doc_id, quality as n from labels) a
    join (select doc_id, toxic as n from labels) b on a.doc_id = b.doc_id""")
def _(t):
    labels = t("labels")
    return relate.merge(
        labels.select("doc_id", F.col("quality").alias("n")), labels.select("doc_id", F.col("toxic").alias("n")), "doc_id")


_CODONS = r"""
    with m as (select Hugo_Symbol, HGVSp_Short, Hugo_Symbol || '_' || left(substring(HGVSp_Short, 3), 1) ||
      regexp_replace(substring(HGVSp_Short, 3), '^.|.$', '', 'g') as codon_id from mutations)
    select m.Hugo_Symbol, substring(m.HGVSp_Short, 3) as HGVSp_Short, m.codon_id,
      case when h.codon_id is not null then 1 else 0 end as labels_driver_mutation
    from m left join (select {how} codon_id from hotspots) h on m.codon_id = h.codon_id"""


def _codon_labels(t, dedup):
    keyed = with_codon_key(split_protein_change(t("mutations").select("Hugo_Symbol", "HGVSp_Short")))
    labelled = label_by_codon(keyed, codon_labels(t("hotspots")), dedup)
    return labelled.select("Hugo_Symbol", "HGVSp_Short", "codon_id", "labels_driver_mutation")


@query("label_codons", _CODONS.format(how="distinct"))
def _(t):
    return _codon_labels(t, True)


@query("label_codons_repeated", f"""
    select labels_driver_mutation, count(*) as n from ({_CODONS.format(how='all')}) group by labels_driver_mutation""")
def _(t):
    return _codon_labels(t, False).groupBy("labels_driver_mutation").agg(F.count("*").alias("n"))


@query("membership_flag", """
    select c_custkey, cast(exists (select 1 from orders where o_custkey = c_custkey) as int) as has_orders from customer""")
def _(t):
    return relate.with_membership(t("customer").select("c_custkey"), "c_custkey", t("orders"), "o_custkey", "has_orders")


@query("union_all", "select P1 as node from edges union all select P2 from edges")
def _(t):
    edges = t("edges")
    return relate.union_all(edges.select(F.col("P1").alias("node")), edges.select(F.col("P2").alias("node")))


@query("union_distinct", "select P1 as node from edges union select P2 from edges")
def _(t):
    edges = t("edges")
    return relate.union_distinct(edges.select(F.col("P1").alias("node")), edges.select(F.col("P2").alias("node")))


@query("exclude_listed", """
    select c_custkey, c_name from customer c where not exists
      (select 1 from orders where o_custkey = c_custkey and o_totalprice > 350000)""")
def _(t):
    listed = t("orders").filter("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))
    return relate.drop_listed(t("customer").select("c_custkey", "c_name"), listed, ["c_custkey"])
