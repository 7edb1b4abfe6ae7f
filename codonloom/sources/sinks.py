"""File sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codonloom.operators.ordering import hash_rank


def checked(df: DataFrame, sep: str) -> DataFrame:
    """Text columns whose values would break a line apart stop the write with an error."""
    def safe(c: str):
        broken = F.col(c).contains(sep) | F.col(c).contains("\n") | F.col(c).contains("\r")
        return F.when(broken, F.raise_error(F.concat(F.lit(f"column {c} holds a separator or line break: "), F.left(c, F.lit(80))))).otherwise(F.col(c))

    return df.withColumns({f.name: safe(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def escaped(df: DataFrame) -> DataFrame:
    """Text columns with backslash, tab, line feed and carriage return written as two characters each."""
    def plain(c: str):
        value = F.col(c)
        for raw, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            value = F.replace(value, F.lit(raw), F.lit(code))
        return value

    return df.withColumns({f.name: plain(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def write_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True,
                    quote: str = "", partition_by: tuple[str, ...] = (), escape: bool = False) -> None:
    """Delimited text, unquoted by default; a missing value is written `NA`.

    A value that holds the separator or a line break is an error, unless `escape` writes tabs
    and breaks as two characters (see `readers.unescaped`).
    """
    if not quote:
        df = checked(escaped(df) if escape else df, sep)
    writer = (
        df.write.mode("overwrite")
        .option("sep", sep).option("header", header).option("quote", quote)
        .option("escapeQuotes", False).option("nullValue", "NA").option("emptyValue", "")
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_tsv(df: DataFrame, path: str, header: bool = True, escape: bool = False) -> None:
    write_delimited(df, path, header=header, escape=escape)


def write_spaced(df: DataFrame, path: str, header: bool = True) -> None:
    write_delimited(df, path, sep=" ", header=header)


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite").option("header", True)
        .option("nullValue", "NA").option("escape", '"').csv(path)
    )


def assign_batches(ids: DataFrame, id_column: str, size: int = 300) -> DataFrame:
    """Number distinct ids into batches of at most `size`, in a stable order."""
    ranked = hash_rank(ids.select(id_column).distinct(), [id_column], name="rank")
    batch = ((ranked["rank"] - 1) / size).cast("long") + 1
    return ranked.select(id_column, batch.alias("batch_id"))


def write_batches(ids: DataFrame, id_column: str, path: str, size: int = 300) -> None:
    """One header-less file set per batch of ids.

    The rows are shuffled by batch first, so a batch is one file of at most `size` lines.
    """
    batches = assign_batches(ids, id_column, size).repartition("batch_id")
    write_delimited(batches, path, header=False, partition_by=("batch_id",))
