"""SimHash fingerprints and near-duplicate groups found with Golay-code keys.

A fingerprint of 64 bits is cut into three segments. If two fingerprints differ in three
bits or fewer, at most one segment holds two of them, so in some pair of segments each
differs in one bit or none. The perfect binary Golay code of length 23 then gives a common
key: every segment lies within three bits of exactly one codeword, and that codeword lies
within four bits of the other segment. So each fingerprint offers its nearest codewords
and looks up all codewords within four bits (one, or six for the deepest vectors).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.llm import graph
from codonloom.llm.arrow import map_texts
from codonloom.llm.ngrams import LOWER
from codonloom.session import stage

RADIUS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `width` words, or of all words where there are fewer."""
    words = text.translate(LOWER).split()
    if len(words) <= width:
        runs = [b" ".join(words)] if words else []
    else:
        runs = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(r, 42) for r in runs), np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the bits set in over half of them; none set where it is empty.

    Eight counters of a byte each are added at a time, so runs are cut at 255 hashes first.
    """
    sizes = np.array([len(h) for h in hashes], np.int64)
    result = np.zeros(len(hashes), np.uint64)
    if not sizes.sum():
        return result
    flat = np.concatenate(hashes)
    pieces = -(-sizes // 255)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * within
    full = np.flatnonzero(sizes)
    firsts = (np.cumsum(pieces) - pieces)[full]
    lane = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((flat >> np.uint64(bit)) & lane, starts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), firsts, axis=0)
        for byte in range(8):
            over = 2 * counts[:, byte] > sizes[full]
            result[full] |= over.astype(np.uint64) << np.uint64(8 * byte + bit)
    return result


def fingerprints(docs: DataFrame, width: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`fp` (64 bits as a signed long) of every row; texts without words get zero."""
    return map_texts(docs, lambda texts: [majority([shingle_hashes(t, width) for t in texts]).view(np.int64)], "fp bigint", keep)


def _remainder(values: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator."""
    rest = values.copy()
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (_GENERATOR << (bit - 11)), rest)
    return rest


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """By remainder: the nearest codeword's difference, and messages of the codewords that
    come within four bits, as differences to the nearest one (-1: none)."""
    message = np.arange(1 << 12, dtype=np.int64)
    words = (message << 11) ^ _remainder(message << 11)
    sevens = words[np.bitwise_count(words.astype(np.uint64)) == 7]
    leader, near = np.zeros(1 << 11, np.int64), np.full((1 << 11, 5), -1, np.int64)
    for weight in range(1, 4):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            at = int(_remainder(np.array([error]))[0])
            leader[at] = error
            if weight == 3:
                near[at] = sevens[(sevens & error) == error] >> 11
    return leader, near


def golay_keys(values: np.ndarray) -> np.ndarray:
    """Messages of the codewords near each 23-bit value: the nearest first, then five or -1."""
    leader, near = _golay()
    at = _remainder(values)
    nearest = (values ^ leader[at]) >> 11
    others = near[at]
    return np.concatenate([nearest[:, None], np.where(others < 0, -1, others ^ nearest[:, None])], axis=1)


def pair_keys(fps: np.ndarray, lookup: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: one key for each pair of segments, or all keys to look up."""
    parts = [golay_keys(((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64)) for s, w in SEGMENTS]
    rows, keys = [], []
    for number, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        for x in range(6 if lookup else 1):
            for y in range(6 if lookup else 1):
                there = np.flatnonzero((parts[i][:, x] >= 0) & (parts[j][:, y] >= 0))
                rows.append(there)
                keys.append((number << 24) | (parts[i][there, x] << 12) | parts[j][there, y])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame, lookup: bool, name: str) -> DataFrame:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 2000):
                part = values[at:at + 2000]
                row, key = pair_keys(part.view(np.uint64), lookup)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", name])

    return fps.select("fp").mapInArrow(batches, f"key bigint, {name} bigint")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (`a`, `b`) of the distinct fingerprints in column `fp` that differ in 1 to 3 bits.

    Only pairs that pass the exact test leave the join, each once for a key they share.
    """
    offered, looked_up = _keyed(fps, False, "a"), _keyed(fps, True, "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    return looked_up.join(offered.hint("shuffle_hash"), (looked_up["key"] == offered["key"]) & close).select("a", "b")


def groups(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """`fp` and `component` (smallest key reachable through links) of the rows in `marked`.

    `marked` (key, fp) should be a written table, as it is read twice. Rows with equal
    fingerprints are merged before anything is linked, so copies cost nothing. A null key
    never names a component unless all of its rows are null.
    """
    classes = stage(marked.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    close = stage(links(classes), "links")
    found = graph.components(close)
    # The component's fingerprints carry their first keys; the smallest of these names it.
    joined = classes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root"))
    joined = stage(joined, "roots")
    named = stage(joined.groupBy("root").agg(F.min("first").alias("component")).withColumnRenamed("root", "_root"), "named")
    return stage(joined.join(named, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component"), "members")


def near_duplicates(docs: DataFrame, width: int = 3, key: str = "doc_id") -> DataFrame:
    """`key`, `fp` and `component` of every row of `docs`.

    Null and empty texts have the fingerprint zero and are linked like any other. Repeated
    rows come out as often as they went in; other columns are not carried.
    """
    marked = stage(fingerprints(docs, width, (key,)), "fingerprints")
    found = groups(marked, key)
    return marked.join(found, F.col("fp") == F.col("_fp")).select(key, "fp", "component")
