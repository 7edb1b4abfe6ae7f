"""Domain inputs derived from the test tables.

Each view is one SQL text over whole tables that Spark and DuckDB both read: Spark gets
the tables as DataFrames, the equivalent SQL gets the text as a common table expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from codonloom.session import configure
from codonloom.sources.schemas import MODIFICATIONS, PROCESS_CATEGORIES, RATIO_FEATURES

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
RANKS = tuple(f"r{i:02d}_rankscore" for i in range(1, 13))
# The three score sources do not list the same rank columns; averages take those all of them have.
TEST_RANKS = tuple(f"r{i:02d}_rankscore" for i in (1, *range(4, 15)))
BENCH_RANKS = tuple(f"r{i:02d}_rankscore" for i in range(3, 12))
SHARED_RANKS = tuple(r for r in RANKS if r in TEST_RANKS and r in BENCH_RANKS)


def _residue(x: str) -> str:
    return f"substring('ACDEFGHIKLMNPQRSTVWY', cast({x} % 20 as int) + 1, 1)"


def _base(x: str) -> str:
    return f"substring('ACGT', cast(({x}) % 4 as int) + 1, 1)"


def _text(x: str) -> str:
    return f"cast({x} as string)"


def _choice(x: str, values) -> str:
    cases = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {x} {cases} end"


_GENE = "l_suppkey - l_suppkey % 2"
_ACCESSION = "'P' || lpad(cast(l_suppkey as string), 5, '0')"
_QUANTITY = "cast(l_quantity as bigint)"
_CODON = f"{_text(f'l_linenumber * 100 + {_QUANTITY}')}"
_TYPE = "cast(round(l_discount * 100) as int)"
_KIND = "cast(round(l_tax * 100) as int)"
_CHROMOSOME = _text("l_partkey % 22 + 1")
_SITE = "l_partkey * 100 + l_suppkey % 10"
_REF, _ALT = _base("l_partkey"), _base("l_partkey + 1 + l_suppkey % 3")
_CENT = f"lpad({_text(_QUANTITY)}, 2, '0')"
_BRAND = "cast(substring(p_brand, 7) as int)"
_BGENE = "'G' || cast(o_custkey - o_custkey % 2 as string)"
_BMUTATION = f"{_residue('o_orderkey')} || {_text('o_orderkey')} || {_residue('o_custkey')}"
_BCHROMOSOME = "case when o_orderpriority = '1-URGENT' and o_custkey % 5 = 0 then 'Un_1' else cast(o_custkey % 22 + 1 as string) end"
_BSITE = "o_orderkey * 37 + 1000"
_BREF, _BALT = _base("o_orderkey"), _base("o_orderkey + 1 + o_custkey % 3")

VIEWS: dict[str, str] = {
    "mutations": f"""
        select 'G' || {_text(_GENE)} as Hugo_Symbol, {_GENE} as Entrez_Gene_Id,
          {_CHROMOSOME} as Chromosome, {_SITE} as Start_Position, {_SITE} as End_Position,
          case l_linestatus when 'F' then '+' else '-' end as Strand,
          case l_linenumber when 1 then 'Silent' when 2 then 'xMissense_Mutationx' when 7 then null
            else 'Missense_Mutation' end as Variant_Classification,
          case {_TYPE} when 0 then 'DNP' when 1 then 'DEL' when 2 then 'ONP' when 3 then 'TNP'
            when 4 then 'INS' when 5 then null else 'SNP' end as Variant_Type,
          {_REF} as Reference_Allele, {_REF} as Tumor_Seq_Allele1, {_ALT} as Tumor_Seq_Allele2,
          'p.' || {_residue('l_suppkey')} || {_CODON} || case when {_KIND} = 8 then 'fs*3'
            else {_residue('l_partkey')} end as HGVSp_Short,
          case {_KIND} when 6 then null when 7 then {_ACCESSION} || ',Q00001'
            else {_ACCESSION} end as SWISSPROT,
          case when l_extendedprice >= 50000 then 'driver' else 'passenger' end as class
        from {{lineitem}}""",
    "edges": f"""
        select 'N' || {_text('l_partkey')} as P1, 'N' || {_text('l_suppkey')} as P2 from {{lineitem}}""",
    "id_map": f"""
        select 'N' || {_text('p_partkey')} as from_id, p_partkey - p_partkey % 2 as to_id from {{part}}
        union all
        select 'N' || {_text('p_partkey')}, p_partkey + 1000000000 from {{part}} where p_size > 45""",
    "gene_library": """
        select 'H' as gs_cat, 'HALLMARK_' || p_type as gs_name, p_partkey - p_partkey % 2 as entrez_gene from {part}
        union all
        select 'H', 'HALLMARK_' || p_brand, p_partkey - p_partkey % 2 from {part}
        union all
        select 'H', 'HALLMARK_' || p_type || '_' || p_brand, p_partkey - p_partkey % 2 from {part}
        union all
        select 'C2', 'OTHER_' || p_brand, p_partkey - p_partkey % 2 from {part}""",
    "hallmarks": f"""
        select distinct p_type || '_' || p_brand as Hallmark_name,
          {_choice(_BRAND + ' % 9', PROCESS_CATEGORIES)} as Process_category,
          'sets of ' || p_brand as Description, {_BRAND} as Number_of_founder_sets from {{part}}
        union all
        select distinct p_brand, {_choice(_BRAND + ' % 9', PROCESS_CATEGORIES)},
          'sets of ' || p_brand, {_BRAND} from {{part}}""",
    "ptm_sheet": f"""
        select {_ACCESSION} as ACC, case l_returnflag when 'N' then 'mouse' else 'human' end as ORGANISM,
          case when {_KIND} = 3 then null else
            'm' || {_text('(l_suppkey * 7 + l_linenumber % 4) % 30')} || ', m' ||
            {_text('(l_suppkey * 3 + l_linenumber % 3) % 30')} || ',m' ||
            {_text('(l_suppkey * 7 + l_linenumber % 4) % 30')} end as MODIFICATION_SUMMARY
        from {{lineitem}}""",
    "ptm_key": f"""
        select 'm' || {_text('n_nationkey')} as PTM, {_choice('n_nationkey % 13', MODIFICATIONS)} as Description,
          substring('STYKRN', n_nationkey % 6 + 1, 1) as Amino_acid_by_code from {{nation}}""",
    "ratio_table": f"""
        select 'G' || {_text('s_suppkey - s_suppkey % 2')} as gene, """ + ", ".join(
            f"max(case when s_nationkey <> {i} then s_acctbal * {i + 1} end) as {f}"
            for i, f in enumerate(RATIO_FEATURES)) + """
        from {supplier} group by s_suppkey - s_suppkey % 2""",
    "score_rows": f"""
        select {_CHROMOSOME} || '_' || {_text(_SITE)} || '_' || {_REF} || '/' || {_ALT} as Uploaded_variation,
          case when l_linenumber < 3 and l_returnflag = 'N' then '-' else '0.' || {_CENT} end as SIFT,
          case l_linenumber when 1 then '-' when 2 then 'benign(0.' || {_CENT} || ')'
            when 3 then '0.' || {_CENT} else 'probably_damaging(0.' || {_CENT} || ')' end as PolyPhen,
          case when {_TYPE} = 9 then 'low' else '0.' || {_CENT} end as Condel, """ + ", ".join(
            f"case when (l_linenumber + {i}) % 5 = 0 then '-' else '0.' || "
            f"lpad({_text(f'({_QUANTITY} * {i + 1}) % 100')}, 2, '0') end as {r}"
            for i, r in enumerate(RANKS)) + """
        from {lineitem}""",
    "test_scores": f"""
        select distinct {_CHROMOSOME} || '_' || {_text(_SITE)} || '_' || {_REF} || '/' || {_ALT} as Uploaded_variation,
          case when l_returnflag = 'R' and l_linenumber = 1 then '-' else '0.' || {_CENT} end as SIFT,
          case l_linenumber when 2 then '-' else 'benign(0.' || {_CENT} || ')' end as PolyPhen,
          case when {_TYPE} = 8 then 'high' else '0.' || {_CENT} end as Condel, """ + ", ".join(
            f"case when (l_linenumber + {i}) % 4 = 0 then '-' else '0.' || "
            f"lpad({_text(f'({_QUANTITY} * {i + 3}) % 100')}, 2, '0') end as {r}"
            for i, r in enumerate(TEST_RANKS)) + """
        from {lineitem}""",
    "bench_scores": f"""
        select {_BCHROMOSOME} || '_' || {_text(_BSITE)} || '_' || {_BREF} || '/' || {_BALT} as Uploaded_variation,
          case when o_orderpriority = '4-NOT SPECIFIED' then '-' else '0.' || {_text('o_custkey % 90 + 10')} end as SIFT,
          case when o_orderpriority = '3-MEDIUM' then 'unknown' else 'benign(0.' || {_text('o_orderkey % 90 + 10')} || ')' end as PolyPhen,
          '0.' || {_text('(o_custkey + o_orderkey) % 90 + 10')} as Condel, """ + ", ".join(
            f"case when (o_orderkey + {i}) % 7 = 0 then '-' else '0.' || {_text(f'(o_custkey * {i + 2}) % 90 + 10')} end as {r}"
            for i, r in enumerate(BENCH_RANKS)) + """
        from {orders}""",
    "test_symbols": f"""
        select 'G' || {_text('s_suppkey - s_suppkey % 2')} as query,
          case when s_nationkey = 3 then null else s_suppkey - s_suppkey % 2 end as entrezgene,
          case s_nationkey % 8 when 0 then null when 1 then 'P0' || {_text('s_suppkey')} || ',Q1'
            else 'P' || lpad({_text('s_suppkey')}, 5, '0') end as uniprot
        from {{supplier}}""",
    "bench_sheet": f"""
        select 'N' || {_text('l_suppkey')} as ACC, case l_returnflag when 'A' then 'rat' else 'human' end as ORGANISM,
          'm' || {_text('(l_suppkey * 5 + l_linenumber) % 30')} || ', m' || {_text('(l_suppkey + l_linenumber % 2) % 30')} as MODIFICATION_SUMMARY
        from {{lineitem}}""",
    "hotspots": f"""
        select 'G' || {_text(_GENE)} || '_' || {_residue('l_suppkey')} || {_CODON} as codon_id
        from {{lineitem}} where l_extendedprice >= 90000""",
    "symbols": f"""
        select 'G' || {_text('s_suppkey - s_suppkey % 2')} as query,
          case when s_nationkey = 3 then null else s_suppkey - s_suppkey % 2 end as entrezgene,
          case s_nationkey % 4 when 0 then null when 1 then 'P' || {_text('s_suppkey')} || ',Q' || {_text('s_suppkey')}
            else 'P' || {_text('s_suppkey')} end as uniprot
        from {{supplier}}""",
    "protein_rows": f"""
        select 'G' || {_text('s_suppkey - s_suppkey % 2')} as symbol, 'N' || {_text('s_suppkey')} as Entry,
          s_suppkey as row_no from {{supplier}}""",
    "bench_mutations": f"""
        select {_BGENE} as gene, {_BMUTATION} as mutation,
          case o_orderstatus when 'F' then 'Non-neutral' when 'O' then 'neutral' else null end as label
        from {{orders}}""",
    "coordinate_rows": f"""
        select {_BGENE} || ':p.' || {_BMUTATION} as input,
          'chr' || {_BCHROMOSOME} || ':g.' || {_text(_BSITE)} ||
            case when o_orderstatus = 'P' then '_' || {_text(_BSITE + ' + 2')} || 'delinsAA'
              else {_BREF} || '>' || {_BALT} end || '/c.' || {_text('o_orderkey')} || '/p.' || {_BMUTATION} as coordinates,
          case when o_custkey % 2 = 0 then '+' else '-' end as strand
        from {{orders}}""",
    "competitor_rows": f"""
        select 'chr' || {_BCHROMOSOME} as Chrom, {_BSITE} as Position, {_BREF} as Ref_Base, {_BALT} as Alt_Base,
          case when o_orderpriority = '5-LOW' then null else o_totalprice / 600000 end as score
        from {{orders}}""",
    "predictions": """
        select o_orderkey as row_id, case when o_orderstatus = 'F' then 'driver' else 'passenger' end as obs,
          case when o_totalprice >= 250000 then 'driver' else 'passenger' end as pred,
          floor(o_totalprice / 600) / 1000 as score, (o_custkey % 97) / cast(97 as double) as rival,
          cast(o_orderkey % 10 as int) as fold
        from {orders}""",
    "labelled_docs": """
        select l.doc_id, case when l.quality = 1 then 'driver' else 'passenger' end as class,
          d.n_chars / cast(40000 as double) as score, d.lang, d.source
        from {labels} l join {documents} d on l.doc_id = d.doc_id""",
}
# Words SQL reserves get their domain names back on the Spark side.
_RENAMES = {"id_map": {"from_id": "From", "to_id": "To"}}


class Tables:
    """Test tables and views by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        text = VIEWS[name]
        used = {t: self(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used).withColumnsRenamed(_RENAMES.get(name, {}))


def view_sql(name: str) -> str:
    """The view over tables registered under their own names."""
    return reduce(lambda s, t: s.replace("{" + t + "}", t), TABLES, VIEWS[name])
