"""File sources. Every reader takes a declared schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codonloom.functions.numeric import finite
from codonloom.session import stage
from codonloom.sources import schemas


def read_delimited(spark: SparkSession, path, schema: T.StructType, sep: str = "\t",
                   header: bool = True, quote: str = "") -> DataFrame:
    """Delimited text; `NA` is a missing value. `path` may be a glob or a list."""
    return (
        spark.read.schema(schema)
        .option("sep", sep).option("header", header).option("quote", quote)
        .option("nullValue", "NA").option("mode", "FAILFAST")
        .csv(path)
    )


def unescaped(df: DataFrame) -> DataFrame:
    """Text columns of a file that was written with `escape`, as they were."""
    def raw(c: str):
        # Backslash pairs go first, to a character that text does not hold, so that `\\\\t` is no tab.
        value = F.replace(F.col(c), F.lit("\\\\"), F.lit("\ue000"))
        for code, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\ue000", "\\")):
            value = F.replace(value, F.lit(code), F.lit(char))
        return value

    return df.withColumns({f.name: raw(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def read_with_rejects(spark: SparkSession, path, schema: T.StructType, sep: str = "\t", header: bool = True,
                      quote: str = "") -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and (`file_name`, `line`) of the lines that do not.

    Lines with other field counts or values of another type are set aside instead of ending
    the read. Files are read once, into a written table that both results come from.
    """
    read = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField("_line", T.StringType())]))
        .option("sep", sep).option("header", header).option("quote", quote).option("nullValue", "NA")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path)
    )
    held = stage(read.select("*", F.col("_metadata.file_name").alias("_file")), "read")
    good = held.filter(F.col("_line").isNull()).select(*schema.names)
    return good, held.filter(F.col("_line").isNotNull()).select(F.col("_file").alias("file_name"), F.col("_line").alias("line"))


def read_tsv(spark: SparkSession, path, schema: T.StructType, header: bool = True) -> DataFrame:
    return read_delimited(spark, path, schema, header=header)


def read_csv(spark: SparkSession, path, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """Quoted CSV. `multiline` allows line breaks in a field; such files are not split."""
    return (
        spark.read.schema(schema).option("header", True).option("escape", '"')
        .option("nullValue", "NA").option("multiLine", multiline).option("mode", "FAILFAST")
        .csv(path)
    )


def read_row_named(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Text whose header lacks a name for the leading row-name column.

    `schema` names every data column, the row-name column first, so the short header
    line is only skipped.
    """
    return (
        spark.read.schema(schema)
        .option("sep", "\t").option("header", True).option("enforceSchema", True)
        .option("quote", "").option("nullValue", "NA").option("mode", "FAILFAST")
        .csv(path)
    )


def read_whitespace(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Fields separated by any run of blanks, with a header line in each file.

    Only the first line of a file is skipped, whatever later lines hold. A line with more or
    fewer fields than `schema` is an error; empty lines are left out.
    """
    lines = (
        spark.read.schema("value string").option("header", True).option("sep", "\u0001")
        .option("quote", "").option("mode", "FAILFAST").csv(path)
    )
    parts = F.split(F.trim("value"), r"\s+")
    wrong = F.raise_error(F.concat(F.lit(f"not {len(schema.fields)} fields: "), F.col("value")))
    rows = lines.select(F.when(F.size(parts) == len(schema.fields), parts).otherwise(wrong).alias("parts"))

    def field(i: int, f: T.StructField):
        text = F.nullif(F.get("parts", F.lit(i)), F.lit("NA"))
        value = text.cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = finite(value)
        return value.alias(f.name)

    return rows.select(*[field(i, f) for i, f in enumerate(schema.fields)])


def read_many(spark: SparkSession, pattern, schema: T.StructType) -> DataFrame:
    """All files matching `pattern` as one table, with the file each row came from."""
    return read_tsv(spark, pattern, schema).select("*", F.col("_metadata.file_name").alias("file_name"))


def read_hallmark_categories(spark: SparkSession, path) -> DataFrame:
    return read_row_named(spark, path, schemas.HALLMARK_CATEGORIES)


def gene_sets(library: DataFrame, category: str = "H") -> DataFrame:
    """(term, gene) pairs of one collection of a gene-set library."""
    return (
        library.filter(F.col("gs_cat") == category)
        .select(F.col("gs_name").alias("term"), F.col("entrez_gene").alias("gene"))
    )


def symbol_map(table: DataFrame) -> DataFrame:
    """Symbol lookup with the protein accessions as an array (0, 1 or many)."""
    accessions = F.array_compact(F.transform(F.split("uniprot", ","), lambda a: F.nullif(F.trim(a), F.lit(""))))
    return table.select("query", "entrezgene", accessions.alias("uniprot"))
