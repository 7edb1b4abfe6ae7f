"""Mixture-controlled packing of documents into fixed windows of tokens.

Every source is a queue of tokens. A deficit round-robin serves the queues in quanta: the
source that lags furthest behind its share of the mixture sends next, and what it lags is
carried into the next window. With the shares of the corpus itself, quantum j of a source
with U quanta is due at (2 j - 1) / (2 U) of the way, so its turn among all quanta is a sum
of integer divisions over the sources. That makes the schedule computable anywhere: no task
has to wait for the windows before its own, and deficits carry across partitions as well.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonloom.session import stage

WINDOW, QUANTUM, END_ID = 2048, 128, 1


@functools.cache
def encoder(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
    """The byte-level vocabulary at `path` (ranks), with the `special` strings as tokens of their own."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def special_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """Strings and ids that the tokenizer file at `path` (JSON) sets apart from ordinary text."""
    with open(path, encoding="utf-8") as file:
        return tuple((t["content"], t["id"]) for t in json.load(file)["added_tokens"])


def tokenized(docs: DataFrame, path: str, pattern: str, end_id: int = END_ID, special: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """`doc_id`, `source`, `ids` (unsigned 16-bit, end id included), `n`, and where in the
    queue of its source within this partition (`part`) the document starts (`before`).

    A missing text is empty and has the end id alone; a missing source is a source. Where a
    text holds a `special` string, it gets its id there.
    """
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, filled = encoder(path, pattern, special), TaskContext.get().partitionId(), {}
        for batch in rows:
            sources, packed, sizes, before = batch.column(1).to_pylist(), [], [], []
            for text, source in zip(batch.column(2), sources, strict=True):
                ids = np.array([*code.encode(text.as_py(), allowed_special="all"), end_id], np.uint16)
                packed.append(ids.tobytes())
                sizes.append(len(ids))
                before.append(filled.get(source, 0))
                filled[source] = before[-1] + len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array([part] * len(sizes), pa.int32()), pa.array(before, pa.int64())],
                ["doc_id", "source", "ids", "n", "part", "before"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(batches, "doc_id bigint, source string, ids binary, n bigint, part int, before bigint")


def turns(source: np.ndarray, quantum: np.ndarray, quanta: np.ndarray) -> np.ndarray:
    """Place from 0 among all quanta of each source's `quantum` (from 0).

    Counts the quanta due before it: (2 i - 1) / (2 U') < (2 j - 1) / (2 U), ties by source.
    """
    kind = np.int64 if int(quanta.sum()) < 1 << 30 else object  # products must stay exact
    quanta, own = quanta.astype(kind), quanta.astype(kind)[source]
    due, total = 2 * quantum.astype(kind) + 1, np.zeros(len(source), kind)
    for other in range(len(quanta)):
        total = total + (due * quanta[other] + own - (other >= source).astype(kind)) // (2 * own)
    return total.astype(np.int64)


def pieces_of(source: np.ndarray, start: np.ndarray, size: np.ndarray, totals: np.ndarray,
              window: int = WINDOW, quantum: int = QUANTUM) -> tuple[np.ndarray, ...]:
    """(document, first token, length, sequence, offset) of all pieces of documents that lie
    at `start` in the queue of `source`; queues hold `totals` tokens.

    Only the last quantum of a queue may be short. What it lacks moves later quanta of the
    same window forward. Neighbours of one document become one piece.
    """
    quanta, per = -(-totals // quantum), window // quantum
    last = turns(np.flatnonzero(totals), (quanta - 1)[totals > 0], quanta)
    short = (quanta * quantum - totals)[totals > 0]
    first, count = start // quantum, (start + size - 1) // quantum - start // quantum + 1
    doc = np.repeat(np.arange(len(start)), count)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    a = np.maximum(q * quantum, start[doc])
    length = np.minimum((q + 1) * quantum, (start + size)[doc]) - a
    turn = turns(source[doc], q, quanta)
    sequence, offset = turn // per, turn % per * quantum + a - q * quantum
    for place, lack in zip(last, short, strict=True):
        offset -= np.where((sequence == place // per) & (turn > place), lack, 0)
    begin = a - start[doc]
    joint = (doc[1:] == doc[:-1]) & (sequence[1:] == sequence[:-1]) & (offset[1:] == (offset + length)[:-1])
    heads = np.flatnonzero(np.concatenate([[True], ~joint])) if len(doc) else np.zeros(0, np.int64)
    lengths = np.add.reduceat(length, heads) if len(heads) else heads
    return doc[heads], begin[heads], lengths, sequence[heads], offset[heads]


def pack(docs: DataFrame, path: str, pattern: str, window: int = WINDOW, quantum: int = QUANTUM,
         special: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Pieces of all documents: `doc_id`, `source`, `start`, `length`, `ids` (unsigned 32-bit,
    little-endian), `doc_tokens`, `sequence_id`, `offset`.

    All sequences but those that hold the last quantum of a source are full. The order
    within a queue is that of the input partitions. Only one number per source reaches the
    driver; token ids are written once and never shuffled. No documents give no pieces.
    """
    rows = stage(tokenized(docs, path, pattern, special=special), "tokens")
    parts = rows.groupBy("source", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(parts.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "bases")
    shares = {r["source"]: r["n"] for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    number = {s: i for i, s in enumerate(sorted(shares))}
    totals = np.array([shares[s] for s in sorted(shares)], np.int64)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if not batch.num_rows:
                continue
            ids = [np.frombuffer(x, np.uint16) for x in batch.column(2).to_pylist()]
            source = np.array([number[s] for s in batch.column(1).to_pylist()])
            size = batch.column(3).to_numpy()
            doc, begin, length, sequence, offset = pieces_of(source, batch.column(4).to_numpy(), size, totals, window, quantum)
            for at in range(0, len(doc), 50_000):
                cut = slice(at, at + 50_000)
                held = [ids[d][b:b + n].astype("<u4").tobytes() for d, b, n in zip(doc[cut], begin[cut], length[cut], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[cut])), batch.column(1).take(pa.array(doc[cut])), pa.array(begin[cut]),
                     pa.array(length[cut]), pa.array(held, pa.binary()), pa.array(size[doc[cut]]), pa.array(sequence[cut]),
                     pa.array(offset[cut])],
                    ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    placed = rows.join(bases, ["source", "part"]).select("doc_id", "source", "ids", "n", (F.col("base") + F.col("before")).alias("at"))
    return placed.mapInArrow(batches, "doc_id bigint, source string, start bigint, length bigint, ids binary, "
                             "doc_tokens bigint, sequence_id bigint, `offset` bigint")


def with_checksums(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids instead of the ids."""
    return pieces.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
