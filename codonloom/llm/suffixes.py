"""Removal of passages that also start earlier in the corpus, by suffix arrays.

Every byte of a 100-byte string that has an equal string earlier (smaller id, or the same
document further left) goes. Strings are found exactly, in four steps:

1. Of the 32-byte grams in each 100-byte window, the one with the smallest hash is the
   window's anchor. Equal windows have equal anchors, so grams that are the anchor of one
   stretch of windows in the whole corpus need no further look.
2. Around each other anchor, the stretch of text that holds all its windows is cut out. Of
   equal stretches within one task those behind an earlier one go at once.
3. Equal stretches of different tasks meet by a hash, without their bytes; all but the
   earliest go. Stretches that stay meet by gram, where a gram has different ones. Tasks
   sort their suffixes by induced sorting, and permuted common prefixes of 100 and more tie
   equal windows together: all but the earliest go. Grams with very many different
   stretches are settled per window instead.
4. Removed spans meet their document again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonloom.llm.bitmaps import bitmap, set_in
from codonloom.llm.induced import permuted_lcp, suffix_array
from codonloom.session import stage

LENGTH, GRAM = 100, 32
_WIDE = LENGTH - GRAM + 1  # grams in a window
PER_TASK, HOT = 5_000, 5_000
_FLUSH = 400_000  # stretches a task remembers
_PIECE = 10_000  # rows that leave a task at a time
_SEEDS = (1 << 64) - 1
_TABLE = np.random.default_rng(10).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    return h ^ (h >> np.uint64(29))


def rolling(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all strings of `size` bytes, built from strings of half their size."""
    parts, h, span, left = [], _TABLE[seed][data], 1, size
    while True:
        if left & span:
            parts.append((span, h))
            left ^= span
        if not left:
            break
        h = _mix(h[:-span]) * _M2 + h[span:] if len(h) > span else h[:0]
        span *= 2
    count, at, total = len(data) - size + 1, 0, None
    for span, h in reversed(parts):
        piece = h[at:at + count]
        total = piece if total is None else _mix(total) * _M2 + piece
        at += span
    return _mix(total)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a text of 100 bytes or more: the first and last window of every anchor, and its hash.

    The upper half of a gram's hash decides, then the position, so equal windows agree.
    """
    h = rolling(data, GRAM)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= _WIDE:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < _WIDE:
        low = np.minimum(low[:span - _WIDE], low[_WIDE - span:])
    owner = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, np.diff(owner) != 0))
    return first, np.append(first[1:], len(owner)) - 1, h[owner[first]].view(np.int64)


def _grams(docs: DataFrame) -> DataFrame:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [anchors(np.frombuffer(t, np.uint8))[2] for t in batch.column(2).to_pylist() if len(t) >= LENGTH]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["gram"])

    return docs.mapInArrow(batches, "gram bigint")


_SPAN = "doc_id bigint, row_hash bigint, first bigint, past bigint"
_STRETCH = "gram bigint, stretch binary"
_NAMES = ("doc_id", "row_hash", "first", "past", "gram", "stretch")


def _stretches(docs: DataFrame, repeated: np.ndarray) -> DataFrame:
    """Rows with `stretch`: those that nothing a task met before them precedes. Rows without: spans to remove.

    A task remembers a hash and a place of each stretch, not its bytes, which leave at once. Where
    documents come in order, a stretch leaves a task once; otherwise again for each earlier copy.
    """
    held = docs.sparkSession.sparkContext.broadcast(repeated)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, earliest = held.value, {}
        for batch in rows:
            spans, ahead, grams, stretches = [], [], [], []
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, row, text in zip(ids, hashes, (x.as_py() for x in batch.column(2)), strict=True):
                if len(text) < LENGTH:
                    continue
                before = ((doc << 64) + row + (1 << 63)) << 40  # documents in order, one number each
                first, last, gram = anchors(np.frombuffer(text, np.uint8))
                kept = np.flatnonzero(set_in(words, gram))
                for a, b, g in zip(first[kept].tolist(), last[kept].tolist(), gram[kept].tolist(), strict=True):
                    stretch = text[a:b + LENGTH]
                    here = before + a
                    there = earliest.setdefault(key := xxhash.xxh3_128_digest(stretch, g & _SEEDS), here)
                    if there < here:
                        if spans and spans[-1][:2] == (doc, row) and spans[-1][2] <= a <= spans[-1][3]:
                            spans[-1] = (doc, row, spans[-1][2], max(spans[-1][3], b + LENGTH))
                        else:
                            spans.append((doc, row, a, b + LENGTH))
                    elif here < there or here is there:  # repeated rows are one document
                        earliest[key] = here
                        ahead.append((doc, row, a, b + LENGTH))
                        grams.append(g)
                        stretches.append(stretch)
                if len(stretches) + len(spans) > _PIECE:
                    yield _rows(ahead + spans, grams + [None] * len(spans), stretches + [None] * len(spans))
                    spans, ahead, grams, stretches = [], [], [], []
                if len(earliest) > _FLUSH:
                    earliest.clear()
            if stretches or spans:
                yield _rows(ahead + spans, grams + [None] * len(spans), stretches + [None] * len(spans))

    return docs.mapInArrow(batches, f"{_SPAN}, {_STRETCH}")


def _rows(spans: list[tuple], grams: list, stretches: list) -> pa.RecordBatch:
    held = np.array(spans, np.int64).reshape(-1, 4)
    return pa.RecordBatch.from_arrays(
        [*[pa.array(np.ascontiguousarray(held[:, i])) for i in range(4)], pa.array(grams, pa.int64()), pa.array(stretches, pa.binary())],
        [*_NAMES])


def later_windows(stretches: list[bytes], place: np.ndarray) -> list[np.ndarray]:
    """Per stretch its windows that equal a window with a smaller `place` + offset.

    `place` orders the stretches' first windows; of two windows the one with the smaller
    (place, offset) is earlier.
    """
    sizes = np.array([len(x) for x in stretches])
    start = np.cumsum(sizes) - sizes
    text = np.append(np.frombuffer(b"".join(stretches), np.uint8).astype(np.int64) + 1, 0)
    order = suffix_array(text)
    cluster = np.empty(len(text), np.int64)
    cluster[order] = np.cumsum(permuted_lcp(text, order)[order] < LENGTH)
    count = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(sizes)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    same = cluster[start[owner] + offset]
    rank = np.lexsort((offset, place[owner], same))
    later = np.zeros(len(owner), bool)
    later[rank[1:]] = same[rank[1:]] == same[rank[:-1]]
    bounds = np.cumsum(count)[:-1]
    return [np.flatnonzero(x) for x in np.split(later, bounds)]


def _settle(gathered: DataFrame) -> DataFrame:
    """Spans to remove among the stretches of one partition, which holds all of a gram's."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in rows if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "row_hash", "first")])
        spans = np.stack([table.column(c).to_numpy() for c in ("doc_id", "row_hash", "first", "past")], 1)
        seen: dict[tuple[int, bytes], int] = {}
        kinds: dict[int, int] = {}
        removed, kept = [], []
        for i, key in enumerate(zip(table.column("gram").to_pylist(), table.column("stretch").to_pylist(), strict=True)):
            if seen.setdefault(key, i) != i:
                if (spans[i] != spans[seen[key]]).any():
                    removed.append(spans[i])
            else:
                kinds[key[0]] = kinds.get(key[0], 0) + 1
                kept.append(key)
        several = [k for k in kept if kinds[k[0]] > 1]
        if several:
            at = np.array([seen[k] for k in several])
            # Rows are in document order, so their numbers order first windows of different
            # documents; within a document the first window itself does.
            document = np.cumsum(np.append(0, (np.diff(spans[:, :2], axis=0) != 0).any(1)))
            for i, gone in zip(at, later_windows([k[1] for k in several], document[at] * (1 << 40) + spans[at, 2]), strict=True):
                if len(gone):
                    for run in np.split(gone, np.flatnonzero(np.diff(gone) > LENGTH) + 1):
                        removed.append(np.array([*spans[i, :2], spans[i, 2] + run[0], spans[i, 2] + run[-1] + LENGTH]))
        if removed:
            gone = np.stack(removed)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(gone[:, i])) for i in range(4)], ["doc_id", "row_hash", "first", "past"])

    return gathered.mapInArrow(batches, _SPAN)


def _settle_hot(hot: DataFrame) -> DataFrame:
    """The same window by window: the first of each 128-bit hash stays, the others go."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                data = [np.frombuffer(x, np.uint8) for x in part.column(5).to_pylist()]
                if not data:
                    continue
                count = np.array([len(x) - LENGTH + 1 for x in data])
                owner = np.repeat(np.arange(len(data)), count)
                start = part.column(2).to_numpy()[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.concatenate([rolling(x, LENGTH, seed) for x in data]).view(np.int64)) for seed in (0, 1)],
                     *[pa.array(part.column(i).to_numpy()[owner]) for i in (0, 1)], pa.array(start)], ["w0", "w1", "doc_id", "row_hash", "first"])

    windows = hot.mapInArrow(batches, "w0 bigint, w1 bigint, doc_id bigint, row_hash bigint, first bigint")
    windows = stage(windows, "hot_windows")
    here = F.struct("doc_id", "row_hash", "first")
    earliest = stage(windows.groupBy("w0", "w1").agg(F.min(here).alias("e"), F.count("*").alias("n")).filter("n > 1"), "hot_first")
    return windows.join(earliest, ["w0", "w1"]).filter(here != F.col("e")).select(
        "doc_id", "row_hash", "first", (F.col("first") + LENGTH).alias("past"))


def _place():
    return F.xxhash64("doc_id", "row_hash", "first", "gram").alias("place")


def _shipped(open_: DataFrame, firsts: np.ndarray, contested: np.ndarray) -> DataFrame:
    """The stretches whose gram and place have their bits set; a few more do no harm."""
    held = open_.sparkSession.sparkContext.broadcast((firsts, contested))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, grams = held.value
        for batch in rows:
            keep = set_in(grams, batch.column(4).to_numpy()) & set_in(places, batch.column(6).to_numpy())
            if keep.any():
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in range(6)], [*_NAMES])

    return open_.select(*_NAMES, _place()).mapInArrow(batches, f"{_SPAN}, {_STRETCH}")


def removed_spans(docs: DataFrame) -> DataFrame:
    """`doc_id`, `row_hash`, `first` and `past` of byte spans to remove; they may overlap."""
    repeated = stage(_grams(docs).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "repeated")
    # Neighbouring stretches overlap, so this table packs well.
    found = stage(_stretches(docs, bitmap(repeated)), "stretches", compression="zstd")
    sure = found.filter("stretch is null").select("doc_id", "row_hash", "first", "past")
    open_ = found.filter("stretch is not null")
    # Tasks dropped what came behind an earlier copy: few rows a task meet here, without
    # their bytes. The earliest of all stays open; repeated rows tie, as they are one document.
    same = Window.partitionBy("gram", "content").orderBy("doc_id", "row_hash", "first")
    ranked = open_.select("doc_id", "row_hash", "first", "past", "gram", F.xxhash64("stretch").alias("content")).withColumn("rank", F.rank().over(same))
    is_first = F.col("rank") == 1
    told = stage(ranked.select(
        *[F.when(~is_first, F.col(c)).alias(c) for c in ("doc_id", "row_hash", "first", "past")],
        F.when(is_first, F.col("gram")).alias("gram"), F.when(is_first, _place()).alias("place")), "told")
    later = told.filter("gram is null").select("doc_id", "row_hash", "first", "past")
    earliest = told.filter("gram is not null")
    # Only grams with different stretches need a look at the bytes.
    kinds = stage(earliest.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "kinds")
    firsts = bitmap(earliest.select(F.col("place").alias("gram")))
    # At most one gram for every HOT stretches. Spark broadcasts this table only if it is
    # small; then the stretches are shuffled once, to meet by gram.
    crowded = stage(kinds.filter(F.col("n") > HOT).select("gram"), "crowded")
    usual = kinds.filter(F.col("n") <= HOT)
    total = usual.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(1, -(-total // PER_TASK))
    gathered = _shipped(open_, firsts, bitmap(usual)).join(crowded, "gram", "left_anti").select(*_NAMES).repartition(tasks, "gram")
    hot = _shipped(open_, firsts, bitmap(crowded)).join(crowded, "gram", "left_semi").select(*_NAMES)
    return sure.unionByName(later).unionByName(_settle(gathered)).unionByName(_settle_hot(hot))


def _cut(text: bytes, spans: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left."""
    if not len(spans):
        return 0, 0, text
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    heads = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    first, past = spans[heads, 0], np.append(reach[heads[1:] - 1], reach[-1])
    edges = [0, *np.stack([first, past], 1).ravel().tolist(), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return int((past - first).sum()), len(first), kept


def without_repeats(docs: DataFrame) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_removed`, `n_spans` and `kept` (bytes) of every row.

    A null text is empty; texts under 100 bytes lose nothing. Rows with one id and
    different texts come in the order of their texts' hashes; rows that agree in both are
    one document and fare alike. A null id comes first. Other columns are not carried.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))
    spans = removed_spans(rows)
    # No more spans than the document has bytes.
    per_row = stage(spans.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("first", "past")).alias("spans")), "spans")
    # Only texts that may have some move to meet them.
    held = docs.sparkSession.sparkContext.broadcast(bitmap(per_row.select(F.col("row_hash").alias("gram"))))

    def concerned(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield batch.filter(pa.array(set_in(held.value, batch.column(1).to_numpy())))

    def untouched(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            kept = batch.filter(pa.array(~set_in(held.value, batch.column(1).to_numpy())))
            none = pa.array(np.zeros(kept.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), pc.binary_length(kept.column(2)).cast(pa.int64()), none, none, kept.column(2)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    moved = rows.mapInArrow(concerned, "doc_id bigint, row_hash bigint, text binary")
    met = moved.join(per_row, ["doc_id", "row_hash"], "left").select("doc_id", "text", F.col("spans.first").alias("first"), F.col("spans.past").alias("past"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            firsts, pasts, made = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            texts = batch.column(1).to_pylist()
            for t, a, b in zip(texts, firsts, pasts, strict=True):
                made.append(_cut(t, np.array([a or [], b or []], np.int64).T))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([m[0] for m in made], pa.int64()),
                 pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    made = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    done = met.mapInArrow(batches, made).unionByName(rows.mapInArrow(untouched, made))
    return done.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))
