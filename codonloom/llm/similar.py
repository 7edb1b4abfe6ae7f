"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash fingerprints within three bits (see `simhash`) and from MinHash
bands: sixteen bands of five minima bring a pair at 0.8 together with probability 0.998,
while fingerprints at 0.8 differ in some ten bits, out of reach of any radius that can be
joined on. In each bucket texts meet its smallest text, and then all those that this leaves
apart; every candidate is checked by its exact similarity before it links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonloom.llm import graph, simhash
from codonloom.llm.arrow import map_texts
from codonloom.llm.bitmaps import may_hold
from codonloom.llm.ngrams import LOWER, word_grams
from codonloom.session import scratch_scope, stage

WIDTH = 5
BANDS, MINIMA = 16, 5  # bands, and minima in each
LEAST_AGREEMENT = 0.6  # share of equal minima below which a pair cannot be expected at 0.8 (over four deviations)
SHARE_ROWS = 128  # texts compared with one hub in a task
CELL_ROWS = 1024  # texts of a bucket, about, that meet those of another cell in a task
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 63, BANDS * MINIMA, dtype=np.uint64) | np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of all runs of five words, or of all words where there are fewer."""
    words = text.translate(LOWER).split()
    return np.unique(word_grams(words, (min(WIDTH, len(words)),)))


def name_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions; all ones for an empty set."""
    if not len(shingles):
        return np.full(BANDS * MINIMA, np.iinfo(np.uint64).max)
    return ((shingles[None] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(1)


def bands(found: np.ndarray) -> np.ndarray:
    """One key per band of minima."""
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(found.reshape(BANDS, MINIMA))], np.uint64).view(np.int64)


def marked(docs: DataFrame, key: str) -> DataFrame:
    """Key, `name` of the shingle set, its size `m`, SimHash `fp`, band keys and a byte of each minimum."""
    def work(texts: list[bytes]) -> list:
        sets = [shingle_set(t) for t in texts]
        least = [minima(s) for s in sets]
        keys = np.concatenate([bands(x) for x in least])
        return [
            [name_of(s) for s in sets], np.array([len(s) for s in sets], np.int32), simhash.majority(sets).view(np.int64),
            pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys)),
            [(x >> np.uint64(56)).astype(np.uint8).tobytes() for x in least]]

    return map_texts(docs, work, "name bigint, m int, fp bigint, bands array<bigint>, sketch binary", (key,))


def _likely(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The distinct pairs (`a`, `b`) whose sizes and minima allow the similarity."""
    named = pairs.select("a", "b").distinct()
    wanted = named.select(F.col("a").alias("name")).unionByName(named.select(F.col("b").alias("name"))).distinct()
    held = stage(prints.join(wanted, "name", "left_semi").select("name", "m", "sketch").dropDuplicates(["name"]), "held")
    full = named.join(held.select(F.col("name").alias("a"), F.col("m").alias("m1"), F.col("sketch").alias("s1")), "a").join(
        held.select(F.col("name").alias("b"), F.col("m").alias("m2"), F.col("sketch").alias("s2")), "b")
    full = full.filter((F.col("m1") > 0) & (5 * F.least("m1", "m2") >= 4 * F.greatest("m1", "m2")))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(n, BANDS * MINIMA) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= LEAST_AGREEMENT) if n else pa.array([], pa.bool_()))

    return stage(full.select("a", "b", "s1", "s2").mapInArrow(batches, "a bigint, b bigint"), "likely")


def _verified(likely: DataFrame, docs: DataFrame, prints: DataFrame, key: str) -> DataFrame:
    """The pairs (`a`, `b`) of names, given as a written table of distinct ones, whose sets are similar.

    The set of a hub `a` goes once to each share of its partners and theirs once to each
    hub; within a task the hub comes first and is compared with what follows.
    """
    names = likely.select(F.col("a").alias("name")).unionByName(likely.select(F.col("b").alias("name"))).distinct()
    keys = stage(prints.join(names, "name").groupBy("name").agg(F.min(key).alias("_at")).select("_at"), "wanted")
    texts = docs.filter(may_hold(keys, key)).join(keys, F.col(key) == F.col("_at"), "left_semi")

    def work(batch: list[bytes]) -> list:
        found = [shingle_set(t) for t in batch]
        return [[name_of(s) for s in found], [s.tobytes() for s in found]]

    sets = stage(map_texts(texts, work, "name bigint, shingles binary", ()).dropDuplicates(["name"]), "sets")
    sizes = stage(likely.groupBy("a").agg(F.ceil(F.count("*") / SHARE_ROWS).alias("shares")).withColumnRenamed("a", "_a"), "sizes")
    dealt = stage(likely.join(sizes, F.col("a") == F.col("_a")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share")), "dealt")
    partners = dealt.join(sets, F.col("b") == F.col("name")).select("a", "share", "b", "shingles")
    hubs = dealt.select("a", "share").distinct().join(sets, F.col("a") == F.col("name")).select("a", "share", F.lit(None).cast("long").alias("b"), "shingles")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in rows:
            good = []
            for b, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x = np.frombuffer(data, np.uint64)
                if b is None:
                    hub = x
                both = 0 if b is None else len(np.intersect1d(hub, x, assume_unique=True))
                good.append(b is not None and 5 * both >= 4 * (len(hub) + len(x) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    together = hubs.unionByName(partners).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return stage(together.mapInArrow(batches, "a bigint, b bigint"), "similar")


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """Pairs of names whose fingerprints are equal or within three bits of one another."""
    fps = stage(prints.filter("m > 0").groupBy("fp").agg(F.min("name").alias("first")), "fps")
    equal = prints.filter("m > 0").select("fp", "name").distinct().join(fps, "fp").filter("name <> first").select(
        F.col("first").alias("a"), F.col("name").alias("b"))
    close = simhash.links(fps)
    near = close.join(fps.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(
        fps.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return equal.unionByName(near)


def _meeting(few: DataFrame, turn: int = 0) -> DataFrame:
    """Pairs of each bucket's texts with the one that comes first in the order of this turn."""
    order = F.struct(F.xxhash64("name", F.lit(turn)) if turn else F.lit(0).cast("long"), "name")
    hubs = stage(few.groupBy("bucket").agg(F.min(order).alias("hub")).select("bucket", F.col("hub.name").alias("hub")), "hubs")
    return few.join(hubs, "bucket").filter("name <> hub")


def _words(sketch: str) -> list[Column]:
    """The bytes of a sketch, eight to a number."""
    return [F.conv(F.hex(F.substring(sketch, 8 * i + 1, 8)), 16, -10).cast("long") for i in range(BANDS * MINIMA // 8)]


def _differing(x: str, y: str) -> Column:
    """Number of bytes in which two lists of words differ: the bits of each byte are folded into its last one."""
    count = F.lit(0)
    for i in range(BANDS * MINIMA // 8):
        bits = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        for shift in (4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        count = count + F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))
    return count


def _apart(rest: DataFrame, prints: DataFrame) -> DataFrame:
    """The distinct pairs (`a`, `b`) of texts in one bucket but in different parts whose sizes and minima allow the similarity.

    `rest` holds (`bucket`, `name`, `part`). The texts of a bucket are dealt to cells by hash,
    those of a large part to cells of their own, and each two cells meet by themselves, so a
    bucket of any size is spread and no two cells of one part meet.
    """
    shares = stage(rest.groupBy("bucket", "part").agg(F.count("*").alias("n")).select(
        "bucket", "part", "n", (F.col("n") > CELL_ROWS).alias("large")), "shares")
    small = stage(shares.groupBy("bucket").agg(F.sum(F.when(F.col("large"), 0).otherwise(F.col("n"))).alias("small")), "small")
    wide = shares.join(small, "bucket").select(
        "bucket", "part", F.when(F.col("large"), F.col("part")).alias("own"),
        F.ceil(F.when(F.col("large"), F.col("n")).otherwise(F.col("small")) / CELL_ROWS).alias("width"))
    # A small part stays whole; only a large one is cut.
    cell = F.xxhash64("own", F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("part")).otherwise(F.col("name"))), F.col("width")))
    names = rest.select("name").distinct()
    held = stage(prints.join(names, "name", "left_semi").dropDuplicates(["name"]).select("name", "m", F.array(*_words("sketch")).alias("words")), "held")
    dealt = stage(rest.join(wide, ["bucket", "part"]).withColumn("cell", cell).select("bucket", "cell", "own", "name", "part"), "dealt")
    cells = stage(dealt.groupBy("bucket").agg(F.collect_set(F.struct("cell", F.col("own").alias("of"))).alias("cells")), "cells")
    placed = stage(dealt.join(cells, "bucket").join(held, "name"), "placed")

    def side(tag: str, first: bool) -> DataFrame:
        met = F.filter("cells", lambda c: (c["cell"] >= F.col("cell") if first else c["cell"] <= F.col("cell"))
                       & (F.col("own").isNull() | c["of"].isNull() | (F.col("own") != c["of"])))
        rows = placed.select("bucket", "cell", "name", "part", "m", "words", F.explode(F.transform(met, lambda c: c["cell"])).alias("other"))
        low, high = ("cell", "other") if first else ("other", "cell")
        return rows.select("bucket", F.col(low).alias("low"), F.col(high).alias("high"), *[F.col(c).alias(c + tag) for c in ("name", "part", "m", "words")])

    near = (F.col("part1") != F.col("part2")) & ((F.col("low") != F.col("high")) | (F.col("name1") < F.col("name2")))
    near = near & (5 * F.least("m1", "m2") >= 4 * F.greatest("m1", "m2")) & (
        _differing("words1", "words2") <= int((1 - LEAST_AGREEMENT) * BANDS * MINIMA + 1e-9))
    met = side("1", True).join(side("2", False), ["bucket", "low", "high"]).filter(near)
    return stage(met.select(F.least("name1", "name2").alias("a"), F.greatest("name1", "name2").alias("b")).distinct(), "likely")


def links(docs: DataFrame, prints: DataFrame, key: str) -> DataFrame:
    """Pairs (`a`, `b`) of names of similar sets that connect all candidates that are similar."""
    entries = prints.filter("m > 0").select("name", F.explode("bands").alias("bucket")).distinct()
    entries = stage(entries, "entries")
    shared = stage(entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "shared")
    few = stage(entries.join(shared, "bucket"), "few")
    met = _meeting(few).select(F.col("hub").alias("a"), F.col("name").alias("b"))
    first = _verified(_likely(met.unionByName(_by_fingerprint(prints)), prints), docs, prints, key)
    # What the first round leaves in several components within a bucket meets all across them.
    found = graph.components(first)
    placed = few.join(found, F.col("name") == F.col("node"), "left").select("bucket", "name", F.coalesce("component", "name").alias("part"))
    split = stage(placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("top")).filter("low <> top").select("bucket"), "split")
    rest = stage(placed.join(split, "bucket"), "rest")
    return first.unionByName(_verified(_apart(rest, prints), docs, prints, key))


def groups(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key` and `component`, the smallest key of the group, of every row of `docs`, as a written table.

    `key` must tell texts apart. Texts with equal sets are one; those without words, too.
    Other columns are not carried.
    """
    with scratch_scope(docs.sparkSession) as scope:
        docs = docs.select(key, "text")
        prints = stage(marked(docs, key), "prints")
        found = graph.components(links(docs, prints, key))
        rooted = stage(prints.groupBy("name").agg(F.min(key).alias("first")).join(found, F.col("name") == F.col("node"), "left").select(
            "name", "first", F.coalesce("component", "name").alias("root")), "rooted")
        named = stage(rooted.groupBy("root").agg(F.min("first").alias("component")), "named")
        members = stage(rooted.join(named, "root").select("name", "component"), "members")
        return scope.keep(prints.join(members, "name").select(key, "component"), "groups")
