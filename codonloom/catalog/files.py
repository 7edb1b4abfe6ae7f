"""Sources and sinks: every query writes whole tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonloom.catalog.registry import query
from codonloom.catalog.views import RANKS
from codonloom.operators.scores import variant_scores
from codonloom.session import scratch_path, stage
from codonloom.sources import readers, schemas, sinks

_MUTATIONS = schemas.fields(
    Hugo_Symbol="string", Entrez_Gene_Id="bigint", Chromosome="string", Start_Position="bigint",
    Variant_Classification="string", Variant_Type="string", HGVSp_Short="string", SWISSPROT="string")
_NAMES = [f.name for f in _MUTATIONS.fields]
_SQL = f"select {', '.join(_NAMES)} from mutations"


def _mutations(t):
    return t("mutations").select(*_NAMES)


@query("tsv_round_trip", _SQL)
def _(t):
    path = scratch_path(t.spark, "tsv")
    sinks.write_tsv(_mutations(t), path)
    return readers.read_tsv(t.spark, path, _MUTATIONS)


@query("tsv_without_header", _SQL)
def _(t):
    path = scratch_path(t.spark, "bare")
    sinks.write_tsv(_mutations(t), path, header=False)
    return readers.read_tsv(t.spark, path, _MUTATIONS, header=False)


@query("csv_round_trip", "select doc_id, text, lang from documents")
def _(t):
    path = scratch_path(t.spark, "csv")
    schema = schemas.fields(doc_id="bigint", text="string", lang="string")
    sinks.write_csv(t("documents").select("doc_id", "text", "lang"), path)
    return readers.read_csv(t.spark, path, schema, multiline=True)


@query("spaced_round_trip", """
    select Hugo_Symbol, Start_Position, Reference_Allele, SWISSPROT from mutations""")
def _(t):
    path = scratch_path(t.spark, "spaced")
    schema = schemas.fields(Hugo_Symbol="string", Start_Position="bigint", Reference_Allele="string", SWISSPROT="string")
    sinks.write_spaced(t("mutations").select(*[f.name for f in schema.fields]), path)
    return readers.read_whitespace(t.spark, path, schema)


@query("row_named_round_trip", """
    select cast(row_number() over (order by md5('0|' || Hallmark_name)) as int) as row_no, Hallmark_name, Process_category, Description,
      Number_of_founder_sets, Number_of_founder_sets * 2 as Number_of_genes from hallmarks""")
def _(t):
    path = scratch_path(t.spark, "row-named")
    table = sinks.assign_batches(t("hallmarks"), "Hallmark_name", 1)
    hallmarks = t("hallmarks").withColumn("Number_of_genes", F.col("Number_of_founder_sets") * 2)
    sinks.write_tsv(table.join(hallmarks, "Hallmark_name").select(
        F.col("batch_id").alias("row_no"), "Hallmark_name", "Process_category", "Description",
        "Number_of_founder_sets", "Number_of_genes"), path)
    return readers.read_hallmark_categories(t.spark, path)


@query("many_files_union", "select ACC, ORGANISM, MODIFICATION_SUMMARY from ptm_sheet")
def _(t):
    path = scratch_path(t.spark, "sheets")
    sheet = t("ptm_sheet")
    for organism in ("human", "mouse"):
        sinks.write_tsv(sheet.filter(F.col("ORGANISM") == organism), f"{path}/{organism}")
    return readers.read_many(t.spark, f"{path}/*/*.csv", schemas.MODIFICATION_SHEET).drop("file_name")


@query("gene_set_source", "select gs_name as term, entrez_gene as gene from gene_library where gs_cat = 'H'")
def _(t):
    path = scratch_path(t.spark, "library")
    sinks.write_tsv(t("gene_library"), path)
    return readers.gene_sets(readers.read_tsv(t.spark, path, schemas.GENE_SETS))


@query("symbol_map_source", """
    select query, entrezgene, coalesce(cast(len(string_split(uniprot, ',')) as int), -1) as n_accessions from symbols""")
def _(t):
    path = scratch_path(t.spark, "symbols")
    sinks.write_tsv(t("symbols"), path)
    mapped = readers.symbol_map(readers.read_tsv(t.spark, path, schemas.SYMBOL_MAP))
    return mapped.select("query", "entrezgene", F.coalesce(F.size("uniprot"), F.lit(-1)).alias("n_accessions")
                         ).withColumn("n_accessions", F.when(F.col("n_accessions") < 0, -1).otherwise(F.col("n_accessions")))


@query("variant_score_source", """
    select Uploaded_variation, sift, polyphen, condel, round(average_rank, 6) as average_rank from variant_level""")
def _(t):
    path = scratch_path(t.spark, "scores")
    sinks.write_tsv(t("score_rows"), path)
    rows = readers.read_tsv(t.spark, path, schemas.variant_score_schema(RANKS))
    return variant_scores(rows).withColumn("average_rank", F.round("average_rank", 6))


@query("batched_export", """
    with ranked as (select Uploaded_variation, row_number() over (
      order by md5('0|' || Uploaded_variation), Uploaded_variation) as nth
      from (select distinct Uploaded_variation from score_rows))
    select Uploaded_variation, cast((nth - 1) // 300 + 1 as bigint) as batch_id from ranked""")
def _(t):
    path = scratch_path(t.spark, "batches")
    sinks.write_batches(t("score_rows"), "Uploaded_variation", path)
    schema = schemas.fields(Uploaded_variation="string", batch_id="bigint")
    return readers.read_tsv(t.spark, path, schema, header=False).select("Uploaded_variation", "batch_id")


@query("staged_table", """
    select Uploaded_variation, sift, polyphen, condel, round(average_rank, 6) as average_rank from variant_level""")
def _(t):
    return stage(variant_scores(t("score_rows")), "scores").withColumn("average_rank", F.round("average_rank", 6))
