"""Composite feature tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from codonloom.catalog.counting import pairs, score_steps
from codonloom.catalog.registry import STEPS, query
from codonloom.catalog.reshaping import modification_steps
from codonloom.catalog.views import SHARED_RANKS
from codonloom.operators.scores import rank_columns
from codonloom.plans import assemble
from codonloom.session import stage
from codonloom.sources.readers import gene_sets, symbol_map
from codonloom.sources.schemas import (
    ALL_FEATURES,
    LABEL,
    MODIFICATION_FLAGS,
    PROCESS_FLAGS,
    RATIO_FEATURES,
)

STEPS["missense"] = r"""
    select distinct * exclude (HGVSp_Short), substring(HGVSp_Short, 3) as HGVSp_Short,
      left(substring(HGVSp_Short, 3), 1) as First_amino_acid,
      regexp_replace(substring(HGVSp_Short, 3), '^.|.$', '', 'g') as Position, right(HGVSp_Short, 1) as Second_amino_acid
    from mutations where Variant_Classification like '%Missense_Mutation%' and length(SWISSPROT) = 6
      and regexp_matches(regexp_replace(substring(HGVSp_Short, 3), '^.|.$', '', 'g'), '^[0-9]+$')
      and Variant_Type not in ('DNP', 'DEL', 'ONP', 'TNP')"""
STEPS["training_rows"] = f"""
    with base as (select distinct Hugo_Symbol, Entrez_Gene_Id, SWISSPROT,
      Chromosome || '_' || cast(Start_Position as varchar) || '_' || Tumor_Seq_Allele1 || '/' || Tumor_Seq_Allele2 as variant_key,
      Hugo_Symbol || '_' || First_amino_acid || Position as mutation from missense),
    wide as (select b.mutation, b.variant_key, d.times as max_no_interactions,
      {', '.join('f.' + c for c in PROCESS_FLAGS)}, {', '.join('p.' + c for c in MODIFICATION_FLAGS)},
      {', '.join('r.' + c for c in RATIO_FEATURES)}, v.sift, v.polyphen, v.condel, v.average_rank,
      case when h.codon_id is not null then 1 else 0 end as labels_driver_mutation
      from base b join gene_degree d on b.Entrez_Gene_Id = d.gene join group_flags f on b.Entrez_Gene_Id = f.grp
      join ptm_flags p on b.SWISSPROT = p.ACC left join ratio_table r on b.Hugo_Symbol = r.gene
      left join variant_level v on b.variant_key = v.Uploaded_variation
      left join (select distinct codon_id from hotspots) h on b.mutation = h.codon_id)
    select * from wide where {' and '.join(c + ' is not null' for c in ALL_FEATURES)}"""


def training_table(t, ranks=None, shared=None):
    return assemble.training_table(
        t("mutations"), t("edges"), t("id_map"), gene_sets(t("gene_library")), t("hallmarks"), t("ptm_sheet"),
        t("ptm_key"), t("ratio_table"), t("score_rows"), t("hotspots"), ranks=ranks, shared=shared)


_MISSENSE = ("Hugo_Symbol", "Entrez_Gene_Id", "Chromosome", "Start_Position", "Strand", "Variant_Type", "SWISSPROT",
             "HGVSp_Short", "First_amino_acid", "Position", "Second_amino_acid", "Tumor_Seq_Allele2", "class")


@query("clean_missense", f"select {', '.join(_MISSENSE)} from missense")
def _(t):
    return assemble.clean_missense(t("mutations")).select(*_MISSENSE)


@query("degree_feature", f"""
    select {', '.join('m.' + c for c in _MISSENSE)}, d.times as max_no_interactions from missense m
    join gene_degree d on m.Entrez_Gene_Id = d.gene""")
def _(t):
    cleaned = assemble.clean_missense(t("mutations")).select(*_MISSENSE)
    return assemble.with_degree(cleaned, pairs(t))


@query("ratio_features", """
    select m.Hugo_Symbol, m.HGVSp_Short, round(r.gene_length, 4) as gene_length, round(r.driver_score, 4) as driver_score
    from missense m join ratio_table r on m.Hugo_Symbol = r.gene""")
def _(t):
    cleaned = assemble.clean_missense(t("mutations"))
    joined = cleaned.join(assemble.ratio_features(t("ratio_table")), F.col("Hugo_Symbol") == F.col("gene"))
    return joined.select("Hugo_Symbol", "HGVSp_Short", F.round("gene_length", 4).alias("gene_length"),
                         F.round("driver_score", 4).alias("driver_score"))


_SHOWN = [c if c != "average_rank" else "round(average_rank, 6) as average_rank" for c in ALL_FEATURES]


@query("training_table", f"select mutation, variant_key, {', '.join(_SHOWN)}, {LABEL} from training_rows")
def _(t):
    return training_table(t).withColumn("average_rank", F.round("average_rank", 6))


@query("training_class_balance", f"select {LABEL}, count(*) as n from training_rows group by {LABEL}")
def _(t):
    return training_table(t).groupBy(LABEL).agg(F.count("*").alias("n"))


@query("symbol_mapping", """
    with one as (select query, entrezgene, uniprot from symbols
      where entrezgene is not null and uniprot is not null and not contains(uniprot, ','))
    select distinct m.Hugo_Symbol, m.HGVSp_Short, m.class, o.entrezgene, o.uniprot
    from mutations m join one o on m.Hugo_Symbol = o.query""")
def _(t):
    mutations = t("mutations").select("Hugo_Symbol", "HGVSp_Short", "class")
    return assemble.map_symbols(mutations, symbol_map(t("symbols"))).select(
        "Hugo_Symbol", "HGVSp_Short", "class", "entrezgene", "uniprot")


STEPS["bench_positions"] = r"""
    with placed as (select input, strand, substring(split_part(coordinates, ':', 1), 4) as chromosome,
      nullif(regexp_extract(coordinates, ':g\.(.*?)/c\.', 1), '') as s from coordinate_rows),
    joined as (select distinct b.gene as Hugo_Symbol, b.mutation as Mutation, p.strand as Strand, p.chromosome as Chromosome,
      regexp_replace(p.s, '.{3}$', '') as Start_Position, substring(p.s, length(p.s) - 2, 1) as Reference_Allele,
      right(p.s, 1) as Alternative_Allele, b.label
      from bench_mutations b join placed p on b.gene || ':p.' || b.mutation = p.input)
    select * from joined where length(Chromosome) <= 2 and length(Start_Position) < 12"""
STEPS["bench_ids"] = """
    with firsts as (select symbol, Entry from (select *, row_number() over (partition by symbol order by row_no) as nth
      from protein_rows) where nth = 1)
    select f.symbol, f.Entry as UniProt_ID, i.to_id as Entrez_Gene_ID from firsts f left join id_map i on f.Entry = i.from_id"""


def bench_table(t):
    positions = assemble.benchmark_positions(t("bench_mutations"), t("coordinate_rows"))
    return assemble.with_gene_ids(positions, t("protein_rows"), t("id_map"))


_BENCH = ("Hugo_Symbol", "Mutation", "Strand", "Chromosome", "Start_Position", "Reference_Allele", "Alternative_Allele", "label")


@query("benchmark_positions", f"select {', '.join(_BENCH)} from bench_positions")
def _(t):
    return assemble.benchmark_positions(t("bench_mutations"), t("coordinate_rows")).select(*_BENCH)


@query("benchmark_table", f"""
    select {', '.join('p.' + c for c in _BENCH)}, i.UniProt_ID, i.Entrez_Gene_ID from bench_positions p
    left join bench_ids i on p.Hugo_Symbol = i.symbol""")
def _(t):
    return bench_table(t).select(*_BENCH, "UniProt_ID", "Entrez_Gene_ID")


@query("competitor_request", """
    select 'chr' || Chromosome as Chromosome, Start_Position, Strand, Reference_Allele, Alternative_Allele from bench_positions""")
def _(t):
    return assemble.competitor_request(assemble.benchmark_positions(t("bench_mutations"), t("coordinate_rows")))


@query("competitor_join", """
    select p.Hugo_Symbol, p.Mutation, case when p.label = 'Non-neutral' then 'driver' else 'passenger' end as label,
      round(c.score, 9) as competitor_score from bench_positions p join competitor_rows c
      on p.Chromosome = substring(c.Chrom, 4) and p.Start_Position = cast(c.Position as varchar)
      and p.Reference_Allele = c.Ref_Base and p.Alternative_Allele = c.Alt_Base
    where p.label is not null and c.score is not null""")
def _(t):
    positions = assemble.benchmark_positions(t("bench_mutations"), t("coordinate_rows"))
    scored = assemble.with_competitor_score(positions, t("competitor_rows"))
    return assemble.recode_benchmark_label(scored).select(
        "Hugo_Symbol", "Mutation", "label", F.round("competitor_score", 9).alias("competitor_score"))


score_steps("test_scores", "test_level", SHARED_RANKS)
score_steps("bench_scores", "bench_level", SHARED_RANKS)
modification_steps("bench_sheet", "bench_codes", "bench_flags")
_GENES = ", ".join(["d.times as max_no_interactions", *["f." + c for c in PROCESS_FLAGS], *["p." + c for c in MODIFICATION_FLAGS],
                    *["r." + c for c in RATIO_FEATURES]])
_WHOLE = " and ".join(c + " is not null" for c in ALL_FEATURES)
STEPS["test_rows"] = f"""
    with ids as (select distinct query, entrezgene, uniprot from test_symbols where entrezgene is not null and length(uniprot) = 6
      and not contains(uniprot, ',')),
    base as (select distinct Hugo_Symbol, Hugo_Symbol || '_' || substring(HGVSp_Short, 3) as mutation,
      Chromosome || '_' || cast(Start_Position as varchar) || '_' || Reference_Allele || '/' || Tumor_Seq_Allele2 as variant_key,
      class as {LABEL} from mutations),
    wide as (select b.mutation, b.variant_key, {_GENES}, v.sift, v.polyphen, v.condel, v.average_rank, b.{LABEL}
      from base b join ids i on b.Hugo_Symbol = i.query join gene_degree d on i.entrezgene = d.gene
      join group_flags f on i.entrezgene = f.grp join ptm_flags p on i.uniprot = p.ACC
      join ratio_table r on b.Hugo_Symbol = r.gene join test_level v on b.variant_key = v.Uploaded_variation)
    select * from wide where {_WHOLE} and {LABEL} is not null"""
STEPS["bench_rows"] = f"""
    with wide as (select b.Hugo_Symbol || '_' || b.Mutation as mutation,
      b.Chromosome || '_' || b.Start_Position || '_' || b.Reference_Allele || '/' || b.Alternative_Allele as variant_key,
      {_GENES}, v.sift, v.polyphen, v.condel, v.average_rank,
      case when b.label = 'Non-neutral' then 'driver' else 'passenger' end as {LABEL}, c.score as competitor_score
      from bench_positions b join competitor_rows c on b.Chromosome = substring(c.Chrom, 4)
        and b.Start_Position = cast(c.Position as varchar) and b.Reference_Allele = c.Ref_Base and b.Alternative_Allele = c.Alt_Base
      join bench_ids i on b.Hugo_Symbol = i.symbol join gene_degree d on i.Entrez_Gene_ID = d.gene
      join group_flags f on i.Entrez_Gene_ID = f.grp join bench_flags p on i.UniProt_ID = p.ACC
      join ratio_table r on b.Hugo_Symbol = r.gene
      join bench_level v on b.Chromosome || '_' || b.Start_Position || '_' || b.Reference_Allele || '/' || b.Alternative_Allele = v.Uploaded_variation
      where b.label is not null)
    select * from wide where {_WHOLE} and competitor_score is not null"""


def _gene_inputs(t, sheet: str) -> assemble.GeneInputs:
    return assemble.GeneInputs(t("edges"), t("id_map"), gene_sets(t("gene_library")), t("hallmarks"), t(sheet), t("ptm_key"), t("ratio_table"))


def shared_ranks(t) -> list[str]:
    """Rank columns that all three score sources have."""
    return rank_columns(t("score_rows"), t("test_scores"), t("bench_scores"))


def test_table(t, shared=None):
    return assemble.test_table(
        t("mutations"), symbol_map(t("test_symbols")), shared or _gene_inputs(t, "ptm_sheet"), t("test_scores"), shared_ranks(t))


def benchmark_features(t, shared=None):
    return assemble.benchmark_features(
        t("bench_mutations"), t("coordinate_rows"), t("protein_rows"), t("id_map"), shared or _gene_inputs(t, "bench_sheet"),
        t("bench_scores"), t("competitor_rows"), shared_ranks(t))


def study_tables(t, ready, ranks=None):
    """What `ready` makes of the training, test and benchmark table and its name.

    All three read the same gene columns, the first two the same protein columns.
    """
    inputs = assemble.with_written_features(_gene_inputs(t, "ptm_sheet"))
    bench = replace(_gene_inputs(t, "bench_sheet"), genes=inputs.genes)
    return assemble.side_by_side(
        t.spark, lambda: ready(training_table(t, ranks, inputs), "training"), lambda: ready(test_table(t, inputs), "test"),
        lambda: ready(benchmark_features(t, bench), "benchmark"))


@query("test_table", f"select mutation, variant_key, {', '.join(_SHOWN)}, {LABEL} from test_rows")
def _(t):
    return test_table(t).withColumn("average_rank", F.round("average_rank", 6))


@query("benchmark_features", f"select mutation, variant_key, {', '.join(_SHOWN)}, {LABEL}, round(competitor_score, 9) as competitor_score from bench_rows")
def _(t):
    return benchmark_features(t).withColumns({"average_rank": F.round("average_rank", 6), "competitor_score": F.round("competitor_score", 9)})


@query("table_sizes", """
    select 'training' as name, count(*) as n, sum(labels_driver_mutation) as n_driver from training_rows
    union all select 'test', count(*), count(*) filter (where labels_driver_mutation = 'driver') from test_rows
    union all select 'benchmark', count(*), count(*) filter (where labels_driver_mutation = 'driver') from bench_rows""")
def _(t):
    def sizes(table, name):
        hit = 1 if name == "training" else "driver"
        return stage(table.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_if(F.col(LABEL) == F.lit(hit)).alias("n_driver")), "sizes")

    frames = study_tables(t, sizes)
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
