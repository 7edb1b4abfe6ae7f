"""From raw documents to packed token windows, in stages that are written and read again.

Every stage but the last returns the columns of its input, one row for each row it keeps.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonloom.llm import decontaminate, packing, quality, secrets, similar
from codonloom.llm.bitmaps import may_hold
from codonloom.session import configure, scratch_path, scratch_scope, stage

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SPECIAL = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
# A model and token ids cannot be said in SQL: the stages are tested against brute force.
ORACLE_SQL = None


def row_key() -> Column:
    """Id and text hash of a row; structs with null in the same place are equal and nulls of ids sort last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_hash"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts do not.

    The model learns from the labelled rows among `docs`; extra columns come along.
    """
    configure(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # The row travels as one column, so that no column of it can clash with those of the verdict.
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality.judge(whole, model, keep=("row",)).filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id.

    Groups are connected by Jaccard similarities of 0.8 or more between sets of five-word
    shingles; SimHash fingerprints and, beyond their radius, MinHash bands find the pairs. Of
    rows that share the smallest id the one whose text hashes lowest stays, of rows equal in
    both any one. Rows without an id come after all others.
    """
    configure(spark)
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("row"), row_key().alias("key"), "text")
    with scratch_scope(spark) as scope:
        found = similar.groups(keyed, "key").groupBy("key").agg(F.min("component").alias("first"), F.count("*").alias("n"))
        # Rows that are alone in their group and have a key of their own stay where they are.
        shared = stage(found.filter((F.col("n") > 1) | (F.col("first") != F.col("key"))).select(
            F.col("key").alias("shared"), (F.col("first") == F.col("key")).alias("stays")), "shared")
        moves = may_hold(shared.select("shared"), "key")
        met = keyed.filter(moves).join(shared, F.col("key") == F.col("shared"), "left").filter(F.coalesce("stays", F.lit(True)))
        kept = met.dropDuplicates(["key"]).select("row.*").unionByName(keyed.filter(~moves).select("row.*"))
        return scope.keep(kept, "without_copies")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage that is similar to a benchmark item."""
    configure(spark)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("key"), "text")
    with scratch_scope(spark) as scope:
        found = decontaminate.matches(keyed.select(F.col("key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        bad = scope.keep(found.select(F.col("doc_id").alias("bad")).distinct(), "contaminated")
    return keyed.join(bad, F.col("key") == F.col("bad"), "left_anti").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span of their texts replaced by ``[secret]``.

    Overlapping spans are replaced together. `n_chars`, where there is such a column,
    becomes the length of the new text. Null texts stay null; other columns, whatever their
    names, come along unchanged.
    """
    configure(spark)
    with scratch_scope(spark) as scope:
        versions = docs.select(secrets.blob_of(F.col("text")).alias("path"), "text")
        found = secrets.scan(versions, scratch_path(spark, "ledger"))
        spans = scope.keep(found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")), "spans")
    # Only texts with a match can have spans, and only they move to meet them.
    matching = F.coalesce(reduce(or_, [F.col("text").rlike(rule.pattern) for rule in secrets.RULES]), F.lit(False))
    whole = docs.filter(matching).select(F.struct(*docs.columns).alias("row"), F.col("text").alias("raw"), secrets.blob_of(F.col("text")).alias("key"))
    joined = whole.join(spans, F.col("key") == F.col("blob"), "left")
    empty = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    walked = F.aggregate("spans", empty, lambda s, x: F.struct(
        F.when(x["start"] >= s["at"], F.concat(s["done"], F.substring(F.col("raw"), s["at"] + 1, x["start"] - s["at"]), F.lit("[secret]")))
        .otherwise(s["done"]).alias("done"), F.greatest(s["at"], x["stop"]).alias("at")))
    masked = F.concat(walked["done"], F.substring(F.col("raw"), walked["at"] + 1, F.length("raw")))
    hit = F.col("spans").isNotNull()
    new = joined.withColumn("masked", F.when(hit & F.col("raw").isNotNull(), masked).otherwise(F.col("raw")))

    def column(name: str) -> Column:
        old = F.col("row").getField(name)
        if name == "text":
            old = F.col("masked")
        elif name == "n_chars":
            old = F.when(hit, F.length("masked").cast(docs.schema[name].dataType)).otherwise(old)
        return old.alias(name)

    return new.select(*[column(name) for name in docs.columns]).unionByName(docs.filter(~matching))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows; see `packing.pack`."""
    configure(spark)
    return packing.with_checksums(packing.pack(docs, VOCABULARY, PATTERN, special=SPECIAL))


STAGES = [
    ("quality", keep_good),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
