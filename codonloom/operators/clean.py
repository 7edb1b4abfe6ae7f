"""Row filters and column shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonloom.functions.text import protein_change, safe_name
from codonloom.operators.ordering import hash_rank

# Variant types that are not single substitutions.
MULTI_BASE_TYPES = ("DNP", "DEL", "ONP", "TNP")


def contains(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.filter(F.col(column).contains(text))


def all_digits(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).rlike("^[0-9]+$"))


def of_length(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.filter(F.length(column) == n)


def length_within(df: DataFrame, column: str, longest: int) -> DataFrame:
    return df.filter(F.length(F.col(column).cast("string")) <= longest)


def excluding(df: DataFrame, column: str, values) -> DataFrame:
    """Drop listed values; a missing value is dropped as well."""
    return df.filter(~F.col(column).isin(*values))


def without_self_pairs(edges: DataFrame, a: str = "P1", b: str = "P2") -> DataFrame:
    """Drop pairs of a node with itself; a pair with an unknown end stays."""
    return edges.filter(F.coalesce(F.col(a) != F.col(b), F.lit(True)))


def equal_to(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == value)


def complete_rows(df: DataFrame, columns=None) -> DataFrame:
    """Rows without a missing value or NaN."""
    return df.dropna("any", subset=list(columns) if columns else None)


def recode_presence(df: DataFrame, source: str, target: str) -> DataFrame:
    """1 where `source` is present, 0 where it is missing."""
    return df.withColumn(target, F.when(F.col(source).isNotNull(), 1).otherwise(0))


def two_way(condition: Column, yes, no) -> Column:
    """`yes` or `no`; a condition that cannot be decided stays missing."""
    return F.when(condition, F.lit(yes)).when(~condition, F.lit(no))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A row id from the content of the row; equal rows share it."""
    return df.select(F.xxhash64(*df.columns).alias(name), "*")


def with_unique_names(df: DataFrame, source: str, id_columns, target: str) -> DataFrame:
    """Syntactic names made unique by `.1`, `.2`, ... on the repeats."""
    named = df.withColumn("_name", safe_name(source))
    ranked = hash_rank(named, id_columns, by=["_name"], name="_nth")
    suffix = F.when(F.col("_nth") > 1, F.concat(F.lit("."), (F.col("_nth") - 1).cast("string")))
    return ranked.select(*df.columns, F.concat("_name", F.coalesce(suffix, F.lit(""))).alias(target))


def split_protein_change(df: DataFrame, column: str = "HGVSp_Short") -> DataFrame:
    """Strip the `p.` of `column` and add its position and both residues."""
    first, position, second = protein_change(column)
    stripped = F.substr(F.col(column), F.lit(3))
    return df.withColumns({
        "Position": position, "First_amino_acid": first, "Second_amino_acid": second, column: stripped,
    })
