"""Projection, recoding, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonloom.catalog.registry import query
from codonloom.functions import text
from codonloom.functions.numeric import finite, indicator, row_mean, to_number
from codonloom.operators import clean
from codonloom.operators.scores import numeric_scores

# Columns --------------------------------------------------------------------------------


@query("select_columns", """
    select Chromosome, Start_Position, End_Position, Tumor_Seq_Allele1 || '/' || Tumor_Seq_Allele2 as allele,
      Strand as strand_sign from mutations""")
def _(t):
    return t("mutations").withColumn(
        "allele", F.concat("Tumor_Seq_Allele1", F.lit("/"), "Tumor_Seq_Allele2")
    ).withColumnRenamed("Strand", "strand_sign").select(
        "Chromosome", "Start_Position", "End_Position", "allele", "strand_sign")


@query("drop_and_copy_columns", """
    select o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderstatus as status_copy from orders""")
def _(t):
    return t("orders").withColumn("status_copy", F.col("o_orderstatus")).drop("o_orderdate", "o_orderpriority")


@query("recode_presence_flag", """
    select Start_Position, case when SWISSPROT is not null then 1 else 0 end as has_protein from mutations""")
def _(t):
    return clean.recode_presence(t("mutations"), "SWISSPROT", "has_protein").select("Start_Position", "has_protein")


@query("recode_two_way", """
    select gene, mutation, case when label = 'Non-neutral' then 'driver'
      when label <> 'Non-neutral' then 'passenger' end as label from bench_mutations""")
def _(t):
    return t("bench_mutations").withColumn(
        "label", clean.two_way(F.col("label") == "Non-neutral", "driver", "passenger"))


@query("content_row_ids", """
    select count(*) as n_rows, count(distinct (o_orderkey, o_custkey, o_totalprice)) as n_ids from orders""")
def _(t):
    ids = clean.with_row_id(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    return ids.agg(F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("n_ids"))


_SAFE = r"""case when regexp_matches(n, '^(\p{L}|[.]([^0-9]|$))') then n else 'X' || n end"""


@query("unique_safe_names", rf"""
    with raw as (select doc_id, regexp_replace(source || '-' || lang, '[^\p{{L}}\p{{N}}._]', '.', 'g') as n from documents),
    named as (select doc_id, {_SAFE} as n from raw),
    ranked as (select doc_id, n, row_number() over (partition by n
      order by md5('0|' || cast(doc_id as varchar)), doc_id) as nth from named)
    select doc_id, n || case when nth > 1 then '.' || cast(nth - 1 as varchar) else '' end as row_name from ranked""")
def _(t):
    docs = t("documents").select("doc_id", F.concat("source", F.lit("-"), "lang").alias("tag"))
    return clean.with_unique_names(docs, "tag", ["doc_id"], "row_name").select("doc_id", "row_name")


# Filters --------------------------------------------------------------------------------

_COLUMNS = ("Hugo_Symbol", "Start_Position", "Variant_Classification", "Variant_Type", "HGVSp_Short", "SWISSPROT")
_LIST = ", ".join(_COLUMNS)


@query("filter_contains", f"select {_LIST} from mutations where Variant_Classification like '%Missense_Mutation%'")
def _(t):
    return clean.contains(t("mutations").select(*_COLUMNS), "Variant_Classification", "Missense_Mutation")


@query("filter_all_digits", r"""
    select Start_Position, regexp_replace(substring(HGVSp_Short, 3), '^.|.$', '', 'g') as residue_position
    from mutations where regexp_matches(regexp_replace(substring(HGVSp_Short, 3), '^.|.$', '', 'g'), '^[0-9]+$')""")
def _(t):
    position = text.trim_ends(text.drop_prefix("HGVSp_Short", 2))
    return clean.all_digits(t("mutations").select("Start_Position", position.alias("residue_position")), "residue_position")


@query("filter_exact_length", f"select {_LIST} from mutations where length(SWISSPROT) = 6")
def _(t):
    return clean.of_length(t("mutations").select(*_COLUMNS), "SWISSPROT", 6)


@query("filter_length_within", "select gs_name, entrez_gene from gene_library where length(cast(entrez_gene as varchar)) <= 3")
def _(t):
    return clean.length_within(t("gene_library").select("gs_name", "entrez_gene"), "entrez_gene", 3)


@query("filter_excluding", f"select {_LIST} from mutations where Variant_Type not in ('DNP', 'DEL', 'ONP', 'TNP')")
def _(t):
    return clean.excluding(t("mutations").select(*_COLUMNS), "Variant_Type", clean.MULTI_BASE_TYPES)


@query("filter_self_pairs", "select P1, P2 from edges where coalesce(P1 <> P2, true)")
def _(t):
    return clean.without_self_pairs(t("edges"))


@query("filter_equal", "select ACC, ORGANISM, MODIFICATION_SUMMARY from ptm_sheet where ORGANISM = 'human'")
def _(t):
    return clean.equal_to(t("ptm_sheet"), "ORGANISM", "human")


@query("filter_complete_rows", """
    select * from mutations where Variant_Classification is not null and Variant_Type is not null
      and SWISSPROT is not null""")
def _(t):
    return clean.complete_rows(t("mutations"))


# Scalar functions -----------------------------------------------------------------------


@query("text_slices", r"""
    select HGVSp_Short, substring(HGVSp_Short, 3) as without_prefix, substring(HGVSp_Short, 4) as from_fourth,
      left(HGVSp_Short, 1) as first_char, right(HGVSp_Short, 1) as last_char,
      substring(HGVSp_Short, length(HGVSp_Short) - 2, 1) as third_from_end,
      regexp_replace(HGVSp_Short, '^.|.$', '', 'g') as inner_text,
      regexp_replace(HGVSp_Short, '.{3}$', '') as without_suffix, cast(length(HGVSp_Short) as bigint) as n_chars
    from mutations""")
def _(t):
    c = "HGVSp_Short"
    return t("mutations").select(
        c, text.drop_prefix(c, 2).alias("without_prefix"), text.from_position(c, 4).alias("from_fourth"),
        text.first_char(c).alias("first_char"), text.last_char(c).alias("last_char"),
        text.char_from_end(c, 3).alias("third_from_end"), text.trim_ends(c).alias("inner_text"),
        text.drop_suffix(c, 3).alias("without_suffix"), F.length(c).cast("bigint").alias("n_chars"))


@query("text_between_markers", r"""
    select input, split_part(coordinates, ':', 1) as before_colon,
      nullif(regexp_extract(coordinates, ':g\.(.*?)/c\.', 1), '') as site from coordinate_rows""")
def _(t):
    return t("coordinate_rows").select(
        "input", text.before("coordinates", ":").alias("before_colon"),
        text.between("coordinates", ":g.", "/c.").alias("site"))


@query("text_in_parentheses", r"""
    select Uploaded_variation, regexp_replace(PolyPhen, '.*\((.*)\).*', '\1') as polyphen_text from score_rows""")
def _(t):
    return t("score_rows").select("Uploaded_variation", text.in_parentheses("PolyPhen").alias("polyphen_text"))


@query("paste_with_missing", """
    select coalesce(Hugo_Symbol, 'NA') || '_' || coalesce(Variant_Type, 'NA') || '_' || coalesce(SWISSPROT, 'NA') as pasted
    from mutations""")
def _(t):
    return t("mutations").select(text.paste("Hugo_Symbol", "Variant_Type", "SWISSPROT", sep="_").alias("pasted"))


@query("numeric_cast", """
    select Uploaded_variation, try_cast(SIFT as double) as sift, try_cast(Condel as double) as condel,
      try_cast(r01_rankscore as double) as r01 from score_rows""")
def _(t):
    return t("score_rows").select(
        "Uploaded_variation", to_number("SIFT").alias("sift"), to_number("Condel").alias("condel"),
        to_number("r01_rankscore").alias("r01"))


@query("numeric_cast_many", r"""
    select Uploaded_variation, try_cast(SIFT as double) as SIFT,
      try_cast(regexp_replace(PolyPhen, '.*\((.*)\).*', '\1') as double) as PolyPhen,
      try_cast(Condel as double) as Condel from score_rows""")
def _(t):
    return numeric_scores(
        t("score_rows").select("Uploaded_variation", "SIFT", "PolyPhen", "Condel"), ["SIFT", "PolyPhen", "Condel"])


@query("split_in_two", """
    select codon_id, split_part(codon_id, '_', 1) as driver_gene, split_part(codon_id, '_', 2) as codon from hotspots""")
def _(t):
    gene, codon = text.split_pair("codon_id", "_")
    return t("hotspots").select("codon_id", gene.alias("driver_gene"), codon.alias("codon"))


@query("cast_and_flag", """
    select cast(Entrez_Gene_Id as varchar) as gene_text, cast(class = 'driver' as int) as is_driver from mutations""")
def _(t):
    return t("mutations").select(
        F.col("Entrez_Gene_Id").cast("string").alias("gene_text"),
        indicator(F.col("class") == "driver").alias("is_driver"))


@query("variant_keys", """
    select Chromosome || '_' || cast(Start_Position as varchar) || '_' || Reference_Allele || '/' || Tumor_Seq_Allele2
      as variant_key from mutations""")
def _(t):
    return t("mutations").select(
        text.variant_key("Chromosome", "Start_Position", "Reference_Allele", "Tumor_Seq_Allele2").alias("variant_key"))


@query("protein_changes", r"""
    select substring(HGVSp_Short, 3) as HGVSp_Short, left(substring(HGVSp_Short, 3), 1) as First_amino_acid,
      regexp_replace(substring(HGVSp_Short, 3), '^.|.$', '', 'g') as Position,
      right(HGVSp_Short, 1) as Second_amino_acid from mutations""")
def _(t):
    return clean.split_protein_change(t("mutations")).select(
        "HGVSp_Short", "First_amino_acid", "Position", "Second_amino_acid")


@query("genomic_changes", r"""
    with sites as (select input, substring(split_part(coordinates, ':', 1), 4) as chromosome,
      nullif(regexp_extract(coordinates, ':g\.(.*?)/c\.', 1), '') as s from coordinate_rows)
    select input, chromosome, regexp_replace(s, '.{3}$', '') as site, substring(s, length(s) - 2, 1) as reference,
      right(s, 1) as alternative from sites""")
def _(t):
    chromosome, site, reference, alternative = text.genomic_change("coordinates")
    return t("coordinate_rows").select(
        "input", chromosome.alias("chromosome"), site.alias("site"), reference.alias("reference"),
        alternative.alias("alternative"))


@query("codon_keys", r"""
    select Hugo_Symbol || '_' || left(substring(HGVSp_Short, 3), 1) ||
      regexp_replace(substring(HGVSp_Short, 3), '^.|.$', '', 'g') as codon_id from mutations""")
def _(t):
    first, position, _second = text.protein_change("HGVSp_Short")
    return t("mutations").select(text.codon_key("Hugo_Symbol", first, position).alias("codon_id"))


@query("nullify_nonfinite", """
    select event_id, round(case when value = 0 then null else ln(value) end, 9) as log_value from events""")
def _(t):
    # ln(0) is missing; the infinity is made to test the clean-up.
    log = F.when(F.col("value") == 0, F.lit(float("-inf"))).otherwise(F.log("value"))
    return t("events").select("event_id", F.round(finite(log), 9).alias("log_value"))


@query("row_means", """
    select s_suppkey, round(case when (s_acctbal > 0) then (s_acctbal + s_nationkey) / 2 else s_nationkey end, 6) as mean_value
    from supplier""")
def _(t):
    positive = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))
    return t("supplier").select("s_suppkey", F.round(row_mean([positive, F.col("s_nationkey")]), 6).alias("mean_value"))
