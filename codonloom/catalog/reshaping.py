"""Lists, long and wide forms, indicator columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonloom.catalog.registry import STEPS, query
from codonloom.operators import reshape
from codonloom.plans.assemble import modification_flags, residue_flags
from codonloom.sources.schemas import MODIFICATIONS, snake

RESIDUES = ("S", "T", "Y", "K", "R", "N")


def modification_steps(sheet: str, codes: str, flags: str) -> None:
    """Steps from a modification sheet to its codes and to one row of flags per protein."""
    STEPS[codes] = f"""
    select ACC, trim(c) as code from (select ACC, unnest(string_split(MODIFICATION_SUMMARY, ',')) as c from {sheet}
      where ORGANISM = 'human') where trim(c) <> ''"""
    STEPS[flags] = "select ACC, " + ", ".join(
        f"max(case when Description = '{m}' then 1 else 0 end) as {snake(m)}" for m in MODIFICATIONS
    ) + f" from {codes} join ptm_key on code = PTM group by ACC"


modification_steps("ptm_sheet", "ptm_codes", "ptm_flags")
_FLAGS = {"A": "returned_a", "N": "returned_n", "R": "returned_r"}


@query("list_to_rows", "select ACC, code from ptm_codes")
def _(t):
    sheet = t("ptm_sheet").filter("ORGANISM = 'human'").select("ACC", "MODIFICATION_SUMMARY")
    return reshape.list_to_rows(sheet, "MODIFICATION_SUMMARY", "code")


@query("text_to_lines", """
    select doc_id, trim(line) as line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
    where trim(line) <> ''""")
def _(t):
    return reshape.list_to_rows(t("documents").select("doc_id", "text"), "text", "line", sep="\n")


@query("wide_to_long", """
    select p_partkey, 'p_brand' as variable, p_brand as value from part
    union all select p_partkey, 'p_type', p_type from part union all select p_partkey, 'p_name', p_name from part""")
def _(t):
    return reshape.wide_to_long(t("part"), ["p_partkey"], ["p_brand", "p_type", "p_name"])


@query("present_members", """
    select Start_Position, Hugo_Symbol, cast((Variant_Type is not null)::int + (SWISSPROT is not null)::int
      + (Variant_Classification is not null)::int as bigint) as n_present,
      concat_ws(',', Variant_Type, SWISSPROT, Variant_Classification) as members from mutations""")
def _(t):
    members = reshape.present_members("Variant_Type", "SWISSPROT", "Variant_Classification")
    return t("mutations").select(
        "Start_Position", "Hugo_Symbol", F.size(members).cast("bigint").alias("n_present"),
        F.array_join(members, ",").alias("members"))


@query("pivot_counts", "select l_suppkey, " + ", ".join(
    f"count(*) filter (where l_returnflag = '{v}') as {n}" for v, n in _FLAGS.items()) + " from lineitem group by l_suppkey")
def _(t):
    return reshape.category_counts(t("lineitem"), "l_suppkey", "l_returnflag", _FLAGS)


@query("pivot_missing_category", """
    select Hugo_Symbol, count(*) filter (where Variant_Type = 'SNP') as snp, count(*) filter (where Variant_Type = 'INS') as ins,
      count(*) filter (where Variant_Type is null) as na_type from mutations group by Hugo_Symbol""")
def _(t):
    return reshape.category_counts(t("mutations"), "Hugo_Symbol", "Variant_Type", {"SNP": "snp", "INS": "ins"}, "na_type")


_TYPES = ("DEL", "DNP", "INS", "ONP", "SNP", "TNP")


@query("pivot_all_categories", "select Hugo_Symbol, " + ", ".join(
    f"count(*) filter (where Variant_Type = '{v}') as {v.lower()}" for v in _TYPES) + """,
      count(*) filter (where Variant_Type is null) as na from mutations group by Hugo_Symbol""")
def _(t):
    """Every category that occurs becomes a column, none of them listed beforehand."""
    mutations = t("mutations")
    names, missing = reshape.discovered(mutations, "Variant_Type")
    return reshape.category_counts(mutations, "Hugo_Symbol", "Variant_Type", names, missing)


@query("pivot_composite_category", "select l_suppkey, " + ", ".join(
    f"count(*) filter (where l_returnflag || '_' || l_linestatus = '{a}_{b}') as {a.lower()}_{b.lower()}"
    for a in "ANR" for b in "FO") + " from lineitem group by l_suppkey")
def _(t):
    names = {f"{a}_{b}": f"{a}_{b}".lower() for a in "ANR" for b in "FO"}
    return reshape.category_counts(t("lineitem"), "l_suppkey", reshape.composite("l_returnflag", "l_linestatus"), names)


@query("modification_flags", "select * from ptm_flags")
def _(t):
    return modification_flags(t("ptm_sheet"), t("ptm_key"))


@query("residue_flags", "select ACC, " + ", ".join(
    f"max(case when Description = '{m}' and Amino_acid_by_code = '{r}' then 1 else 0 end) as {snake(m)}_{r.lower()}"
    for m in MODIFICATIONS for r in RESIDUES) + " from ptm_codes join ptm_key on code = PTM group by ACC")
def _(t):
    return residue_flags(t("ptm_sheet"), t("ptm_key"), RESIDUES)
