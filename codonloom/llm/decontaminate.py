"""Benchmark items inside documents, found by SimHash of item-sized windows.

Three steps, all in DataFrame expressions. A window can only be similar to an item if it
holds one of the item's anchor shingles (any m - ceil(0.8 m) + 1 of its m shingles, as the
others are too few), so windows are drawn around anchors. Window and item fingerprints
within 15 of 64 bits agree within three bits in one of four blocks; items list all block
values that close, windows look up their own, so no such pair is missed. What is left is
compared by its shingles, each with its number of occurrences as weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonloom.session import stage

WIDTH, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 15, 4
_BITS = 64 // BLOCKS
_LANES = 0x0001000100010001
_TOPS = 0x4000400040004000
_MASKS = [x for x in range(1 << _BITS) if x.bit_count() <= RADIUS // BLOCKS]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def shingles_of(words: Column) -> Column:
    """Hashes of all runs of five words; none where there are fewer words."""
    last = F.size(words) - WIDTH
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, WIDTH)))).otherwise(
        F.array().cast("array<bigint>"))


def fingerprint(hashes: Column) -> Column:
    """Bits set in over half of the hashes.

    Sixteen sums hold four counters of 16 bits each; adding 16383 less half the number of
    hashes lifts a counter to bit 14 exactly when it is over half.
    """
    lift = (F.lit(16383) - F.floor(F.size(hashes) / 2)) * F.lit(_LANES)
    sums = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda g: F.aggregate(
        hashes, F.lit(0).cast("long"), lambda total, h: total + F.call_function("shiftrightunsigned", h, g).bitwiseAND(F.lit(_LANES))))
    tops = F.transform(sums, lambda s, g: F.call_function(
        "shiftleft", F.shiftrightunsigned((s + lift).bitwiseAND(F.lit(_TOPS)), 14), g))
    return F.aggregate(tops, F.lit(0).cast("long"), lambda bits, top: bits.bitwiseOR(top))


def _blocks(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, _BITS * i).bitwiseAND(F.lit((1 << _BITS) - 1)).alias("value"))
                     for i in range(BLOCKS)])


def counted(ordered: str) -> Column:
    """Each element of a sorted column with the number of equal ones before it, so that a set
    keeps the weights."""
    return F.transform(ordered, lambda x, i: F.struct(x.alias("x"), (i - F.array_position(F.col(ordered), x)).alias("nth")))


def item_table(benchmark: DataFrame) -> DataFrame:
    """Items with at least five words, their shingles and fingerprint."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item_words"))
    items = items.select("*", shingles_of(F.col("item_words")).alias("item_shingles")).filter(F.size("item_shingles") > 0)
    return items.select("*", F.size("item_shingles").alias("m"), fingerprint(F.col("item_shingles")).alias("item_fp")).distinct()


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`doc_id`, `start` (word, from 0), `m` and the shingles of windows that hold an anchor of
    an item with m shingles; a document shorter than the item is one window."""
    few = (F.col("m") - F.ceil(F.col("m") * F.lit(SIMILARITY) - 1e-9) + 1).cast("int")
    anchors = items.select("m", F.explode(F.slice(F.array_sort("item_shingles"), F.lit(1), few)).alias("anchor")).distinct()
    texts = docs.select("doc_id", "text").filter("text is not null").withColumn("row_hash", F.xxhash64("doc_id", "text"))
    # Expressions inside a lambda are computed for every element: split the text before.
    split = texts.select("doc_id", "row_hash", words_of(F.col("text")).alias("words"))
    spots = split.select("doc_id", "row_hash", F.posexplode(shingles_of(F.col("words"))).alias("at", "shingle"))
    found = spots.join(anchors, spots["shingle"] == anchors["anchor"]).select("doc_id", "row_hash", "m", "at")
    # The hits of one text, no more of them than it has words.
    per_text = stage(found.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("m", "at")).alias("hits")), "hits")
    hit = texts.join(per_text.withColumnRenamed("doc_id", "_id"), (F.col("doc_id").eqNullSafe(F.col("_id"))) & (texts["row_hash"] == per_text["row_hash"]))
    cut = hit.select("doc_id", "hits", words_of(F.col("text")).alias("words")).select("*", shingles_of(F.col("words")).alias("all"))
    room = F.greatest(F.size("all") - F.col("hit.m"), F.lit(0))
    starts = cut.select("doc_id", "all", "words", F.explode("hits").alias("hit")).select(
        "doc_id", "all", "words", F.col("hit.m").alias("m"), F.explode(F.sequence(
            F.least(F.greatest(F.col("hit.at") - F.col("hit.m") + 1, F.lit(0)), room), F.least(F.col("hit.at"), room))).alias("start"))
    return starts.select("doc_id", "m", "start", F.expr("slice(all, start + 1, m)").alias("shingles"),
                         F.expr(f"slice(words, start + 1, m + {WIDTH - 1})").alias("words"))


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`doc_id`, `item_id`, `similarity`, `start` and `n_words` of the best window for every
    document and item at or above `similarity`.

    Texts are compared in lower case. Items with fewer than five words, null texts and
    documents with fewer than five words match nothing. Repeated rows give one result; of
    equally similar windows the first counts. Other columns are not carried.
    """
    items = stage(item_table(benchmark), "items")
    spots = windows(docs, items)
    # Equal windows of many documents are compared once; documents come back at the end.
    marked = stage(spots.select("doc_id", "start", F.size("words").alias("n_words"), "words", "shingles").withColumn(
        "window_hash", F.md5(F.concat_ws(" ", "words"))), "windows")
    distinct = marked.groupBy("window_hash").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles"))
    printed = stage(distinct.select("*", fingerprint(F.col("shingles")).alias("fp")), "prints")
    listed = items.select("item_id", "item_fp", F.explode(_blocks(F.col("item_fp"))).alias("b")).select(
        "item_id", "item_fp", "b", F.explode(F.lit(_MASKS)).alias("mask")).select(
        "item_id", "item_fp", F.col("b.block").alias("block"), F.col("b.value").bitwiseXOR(F.col("mask").cast("long")).alias("value"))
    asked = printed.select("window_hash", "fp", F.explode(_blocks(F.col("fp"))).alias("b")).select(
        "window_hash", "fp", F.col("b.block").alias("block"), F.col("b.value").alias("value"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    pairs = asked.join(listed, ["block", "value"]).filter(close).select("window_hash", "item_id").distinct()

    def runs(words: str) -> Column:
        return F.array_sort(F.transform(F.sequence(F.lit(0), F.size(words) - WIDTH), lambda i: F.concat_ws(" ", F.slice(words, i + 1, WIDTH))))

    full = pairs.join(printed.select("window_hash", "words"), "window_hash").join(items.select("item_id", "item_words"), "item_id")
    full = full.select("*", runs("words").alias("a"), runs("item_words").alias("b"))
    full = full.withColumn("both", F.size(F.array_intersect(counted("a"), counted("b"))))
    both = F.col("both")
    judged = full.select("window_hash", "item_id", (both / (F.size("words") + F.size("item_words") - 2 * (WIDTH - 1) - both)).alias("similarity"))
    # Filtered only once written: a pushed filter would compute the runs inside the lambdas.
    good = stage(judged, "verified").filter(F.col("similarity") >= similarity - 1e-12)
    best = F.max_by(F.struct("start", "n_words"), F.struct("similarity", -F.col("start"), "n_words"))
    placed = marked.select("doc_id", "start", "n_words", "window_hash").join(good, "window_hash")
    return placed.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), best.alias("w")).select(
        "doc_id", "item_id", "similarity", F.col("w.start").alias("start"), F.col("w.n_words").alias("n_words"))
