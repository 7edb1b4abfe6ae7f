"""String expressions: slicing, parsing of variant notations, key building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are not valid as names and get a trailing dot.
RESERVED_WORDS = (
    "if", "else", "repeat", "while", "function", "for", "in", "next", "break",
    "TRUE", "FALSE", "NULL", "Inf", "NaN", "NA",
    "NA_integer_", "NA_real_", "NA_character_", "NA_complex_",
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drop_prefix(c, n: int) -> Column:
    """Everything after the first `n` characters, whatever they are."""
    return F.substr(_col(c), F.lit(n + 1))


def from_position(c, start: int) -> Column:
    return F.substr(_col(c), F.lit(start))


def first_char(c) -> Column:
    return F.left(_col(c), F.lit(1))


def last_char(c) -> Column:
    return F.right(_col(c), F.lit(1))


def char_from_end(c, n: int) -> Column:
    """The n-th character counted from the end."""
    return F.substring(_col(c), -n, 1)


def trim_ends(c) -> Column:
    """Drop the first and the last character."""
    return F.regexp_replace(_col(c), r"^.|.$", "")


def drop_suffix(c, n: int) -> Column:
    """Drop the last `n` characters; shorter text is left alone."""
    return F.regexp_replace(_col(c), ".{%d}$" % n, "")


def before(c, delimiter: str) -> Column:
    return F.substring_index(_col(c), delimiter, 1)


def between(c, left: str, right: str) -> Column:
    """Text between two literal markers, null when they are absent."""
    pattern = r"\Q" + left + r"\E(.*?)\Q" + right + r"\E"
    return F.nullif(F.regexp_extract(_col(c), pattern, 1), F.lit(""))


def in_parentheses(c) -> Column:
    """`benign(0.05)` -> `0.05`; text without parentheses passes through."""
    text = _col(c)
    return F.when(F.contains(text, F.lit("(")), F.regexp_replace(text, r".*\((.*)\).*", "$1")).otherwise(text)


def paste(*cols, sep: str = "") -> Column:
    """Join values with `sep`, spelling a missing one `NA`."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def split_pair(c, delimiter: str) -> tuple[Column, Column]:
    """Exactly two parts; the second is empty when there is no delimiter."""
    parts = F.split(_col(c), r"\Q" + delimiter + r"\E", 2)
    second = F.when(_col(c).isNotNull(), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    return F.get(parts, F.lit(0)), second


def safe_name(c) -> Column:
    """A syntactic name: odd characters become dots, a bad start gets `X`."""
    text = F.coalesce(_col(c).cast("string"), F.lit("NA"))
    name = F.regexp_replace(text, r"[^\p{L}\p{N}._]", ".")
    name = F.when(name.rlike(r"^(\p{L}|[.]([^0-9]|$))"), name).otherwise(F.concat(F.lit("X"), name))
    return F.when(name.isin(*RESERVED_WORDS), F.concat(name, F.lit("."))).otherwise(name)


def protein_change(c, prefixed: bool = True) -> tuple[Column, Column, Column]:
    """`p.V600E` -> first residue, position text, second residue."""
    change = drop_prefix(c, 2) if prefixed else _col(c)
    return first_char(change), trim_ends(change), last_char(change)


def genomic_change(c) -> tuple[Column, Column, Column, Column]:
    """`chr7:g.140453136A>T/c.1799T>A/p.V600E` -> chromosome, position, reference, alternative."""
    site = between(c, ":g.", "/c.")
    chromosome = from_position(before(c, ":"), 4)
    return chromosome, drop_suffix(site, 3), char_from_end(site, 3), last_char(site)


def variant_key(chromosome, position, reference, alternative) -> Column:
    """`7_140453136_A/T`"""
    return F.concat(paste(chromosome, position, reference, sep="_"), F.lit("/"), paste(alternative))


def codon_key(gene, residue, position) -> Column:
    """`BRAF_V600`"""
    return F.concat(paste(gene, residue, sep="_"), paste(position))
