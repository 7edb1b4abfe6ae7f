"""Queries that apply each operator, with production parameters, to its whole test table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from codonloom.llm import (codes, decontaminate, discriminant, lm, packing, quality, secrets, sharding, simhash, suffixes, toxicity, urls,
                           whitening)
from codonloom.session import configure, scratch_path

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.train(docs, _table(spark, folder, "labels")))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select(F.col("doc_id").alias("path"), "text")
    found = secrets.scan(docs, scratch_path(spark, "ledger"))
    base = [r.name for r in secrets.RULES[:3]]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["stop"])), ",")

    def number(rule: str):
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long").alias(f"n_{rule}")

    fixed = F.filter("spans", lambda s: s["rule"].isin(*base))
    return secrets.spans_by_path(docs, found).select(
        F.col("path").alias("doc_id"), *[number(r) for r in base], F.sha2(joined(fixed).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, folder, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = _table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard(docs, ["doc_id", "size", "text_crc32"], 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "passed_on")


def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    good = _table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    return lm.score(_table(spark, folder, "documents").select("doc_id", "text"), good)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    special = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.with_checksums(packing.pack(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.without_repeats(_table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = codes.compress(_table(spark, folder, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    return discriminant.classify(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels"))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(configure(spark), folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_simhash_groups, op2_quality_rules, op3_decontamination, op4_secret_scan, op5_toxicity, op6_feistel_shards,
            op7_url_filters, op8_lm_scores, op9_packing, op10_suffix_dedup, op11_vector_codes, op12_quality_discriminant,
            op13_embedding_whitening, pipeline)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {}
