"""Cross-entropy difference: how much likelier a text is under a target than under the corpus.

Two trigram models over code points share one vocabulary: every code point of all documents
and one symbol for the ends of a text. The counts of both come from all documents and are
exact; those of the background are scaled to the number of target tokens, so that smoothing
treats both alike. Counts and contexts are tables whose size follows the corpus. A text is
scored by what the other texts tell: its own share is taken out of the counts, so neither
membership in the target nor being rare makes a text look likely, and a copy elsewhere does.

Texts are worked on in blocks of bounded size. A block sends each of its trigrams once to be
counted, and gets back the counts of all documents when it is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from codonloom.session import scratch_scope, stage

BLOCK_BYTES = 8 << 20
END = 0x110000  # one above the last code point
_BITS = 21  # of a code point or the end; three of them fit a long
MODELS = ("target", "background")


@dataclass
class Ends:
    """What all trigrams share: symbols, scale of the counts, and sum and kinds of single symbols."""

    symbols: int
    has_target: bool
    ratio: dict[str, float]
    total: dict[str, int]
    kinds: dict[str, float]


def trigrams(text: bytes) -> np.ndarray:
    """Codes of all trigrams of a text with two end symbols before and one behind it."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    s = np.full(len(points) + 3, END, np.int64)
    s[2:-1] = points
    return (s[:-2] << 2 * _BITS) | (s[1:-1] << _BITS) | s[2:]


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows with a `block`: rows of one partition that follow each other, up to `block_bytes` of their `text`.

    The numbers hold for one run only, so the result has to be written before it is used twice.
    """
    names = docs.columns
    at = names.index("text")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = TaskContext.get().partitionId() << 32, 0
        for batch in rows:
            blocks = []
            for text in batch.column(at):
                size = len(text.as_py())
                if filled and filled + size > block_bytes:
                    block, filled = block + 1, 0
                filled += size
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], [*names, "block"])

    return docs.mapInArrow(batches, StructType([*docs.schema.fields, StructField("block", LongType())]))


def count(blocks: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Trigrams (`gram`) of each `block` of `text`, their number `n` and that in rows with `in_target`, `n_target`.

    A block read in several pieces has several rows for a trigram.
    """
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = None, [], 0

        def counted() -> pa.RecordBatch:
            kinds, n = np.unique(np.concatenate([g for g, _ in held]), return_counts=True)
            n_target, chosen = np.zeros(len(kinds), np.int64), [g for g, c in held if c]
            if chosen:
                some, times = np.unique(np.concatenate(chosen), return_counts=True)
                n_target[np.searchsorted(kinds, some)] = times
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), block)), *map(pa.array, (kinds, n, n_target))],
                                              ["block", "gram", "n", "n_target"])

        for batch in rows:
            for number, text, chosen in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (number != block or size + len(text) > block_bytes):
                    yield counted()
                    held, size = [], 0
                block, size = number, size + len(text)
                held.append((trigrams(text), chosen))
        if held:
            yield counted()

    return blocks.select("block", "text", "in_target").mapInArrow(batches, "block bigint, gram bigint, n bigint, n_target bigint")


def _part(i: int) -> Column:
    """Symbol 0, 1 or 2 of a trigram."""
    return F.shiftright("gram", (2 - i) * _BITS).bitwiseAND((1 << _BITS) - 1)


def evidence(counts: DataFrame) -> tuple[DataFrame, Ends]:
    """What the losses of each trigram `gram` rest on, and the numbers all of them share.

    `counts` holds `gram`, `n` and `n_target`. For the trigram, its last two symbols and its
    last one there are the counts under both models (`target3`, `background1`, ...), for the
    first two of these also the sum (`_all`) and the number of kinds (`_kinds`) that follow the
    same context; scaled counts under one are parts of a kind. Without any target token
    the two models are the same.
    """
    tri = stage(counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
                .select("gram", *[_part(i).alias(x) for i, x in enumerate("abc")], "n", "n_target"), "trigrams")
    size = tri.agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).first()  # two numbers
    has_target = bool(size.n_target)
    ratio = {"target": 1.0, "background": size.n_target / size.n if has_target else 1.0}
    held = tri.select("gram", "a", "b", "c", F.col("n_target" if has_target else "n").alias("target3"), F.col("n").alias("background3"))

    def shorter(df: DataFrame, keys: list[str], level: int) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(f"{m}{level + 1}").alias(f"{m}{level}") for m in MODELS])

    def totals(level: int) -> list[Column]:
        return [x for m in MODELS for x in (
            F.sum(f"{m}{level}").alias(f"{m}{level}_all"), F.sum(F.least(F.col(f"{m}{level}") * ratio[m], F.lit(1.0))).alias(f"{m}{level}_kinds"))]

    def following(df: DataFrame, keys: list[str], level: int) -> DataFrame:
        return df.groupBy(*keys).agg(*totals(level))

    two = stage(shorter(held, ["b", "c"], 2), "bigrams")
    one = stage(shorter(two, ["c"], 1), "singles")
    ends = one.agg(F.count("*").alias("symbols"), *totals(1)).first()
    pairs = stage(two.join(following(two, ["b"], 2), "b").join(one, "c"), "pairs")
    found = held.join(following(held, ["a", "b"], 3), ["a", "b"]).join(pairs, ["b", "c"])
    shared = Ends(ends.symbols, has_target, ratio, {m: ends[f"{m}1_all"] or 0 for m in MODELS}, {m: ends[f"{m}1_kinds"] or 0.0 for m in MODELS})
    return found.select("gram", *[c for m in MODELS for c in (
        f"{m}1", *[f"{m}{i}{x}" for i in (2, 3) for x in ("", "_all", "_kinds")])]), shared


def losses(grams: np.ndarray, known: dict[str, np.ndarray], places: np.ndarray, own: np.ndarray, in_target: bool, shared: Ends) -> list[float]:
    """Mean bits of a text under both models, without what the text itself adds to their counts.

    The text has the distinct trigrams `grams`, each `own` times, at `places` of `known`.
    Witten-Bell smoothing mixes the shares of trigrams, bigrams and single symbols down to
    equal shares of all symbols.
    """
    low = (1 << _BITS) - 1
    pairs, first_pair, pair = np.unique(grams & (1 << 2 * _BITS) - 1, return_index=True, return_inverse=True)
    ends, first_end, end = np.unique(pairs & low, return_index=True, return_inverse=True)
    _, middle = np.unique(pairs >> _BITS, return_inverse=True)
    _, front = np.unique(grams >> _BITS, return_inverse=True)
    own2 = np.bincount(pair, own, len(pairs))
    own1 = np.bincount(end, own2, len(ends))
    means = []
    for m in MODELS:
        ratio, taken = shared.ratio[m], float(in_target or m != "target")

        def level(n, own_n, context, total, kinds, lower):
            """Shares of symbols with counts `n`, grouped by `context`, over those one level below."""
            rest = n - taken * own_n
            gone = np.minimum(n * ratio, 1) - np.minimum(rest * ratio, 1)
            total = total - taken * np.bincount(context, own_n)[context]
            kinds = np.maximum(kinds - np.bincount(context, gone)[context], min(ratio, 1.0))
            kinds = np.where(total > 0, kinds, 1.0)
            return (rest * ratio + kinds * lower) / (total * ratio + kinds)

        one = level(known[f"{m}1"][places[first_pair[first_end]]], own1, np.zeros(len(ends), np.int64), shared.total[m], shared.kinds[m], 1 / shared.symbols)
        at = places[first_pair]
        two = level(known[f"{m}2"][at], own2, middle, known[f"{m}2_all"][at], known[f"{m}2_kinds"][at], one[end])
        three = level(known[f"{m}3"][places], own, front, known[f"{m}3_all"][places], known[f"{m}3_kinds"][places], two[pair])
        means.append(float(-(own * np.log2(three)).sum() / own.sum()))
    return means


def score(docs: DataFrame, target_ids: DataFrame, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`n_tokens`, `target_loss`, `background_loss` and `score`, their difference, per token.

    `target_ids` (doc_id) names the target documents. Low scores are close to the target.
    The end of a text is a token, so null and empty texts have one; unknown and null ids
    are never in the target; repeated rows count and are scored one by one. Columns named in
    `keep` come along, whatever their names; an empty table gives an empty one.
    """
    chosen = target_ids.select(F.col("doc_id").alias("id")).distinct().withColumn("chosen", F.lit(True))
    rows = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").alias("key"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    # The flag takes the same way at every size: a merge, whose hot keys are split.
    flagged = rows.join(chosen.hint("merge"), F.col("key") == F.col("id"), "left").select(
        "row", "text", F.coalesce("chosen", F.lit(False)).alias("in_target"))
    numbers = [("n_tokens", LongType()), *[(name, DoubleType()) for name in ("target_loss", "background_loss", "score")]]

    def scored(texts: pa.Table, found: pa.Table) -> pa.Table:
        grams, first = np.unique(found.column("gram").to_numpy(), return_index=True)
        known = {name: found.column(name).to_numpy()[first] for name in found.column_names if name not in ("block", "gram")}
        made = np.zeros((3, texts.num_rows))
        for i, (text, chosen) in enumerate(zip(texts.column("text"), texts.column("in_target").to_pylist(), strict=True)):
            mine, own = np.unique(trigrams(text.as_py()), return_counts=True)
            made[:, i] = own.sum(), *losses(mine, known, np.searchsorted(grams, mine), own, chosen or not shared.has_target, shared)
        columns = [texts.column("row"), pa.array(made[0].astype(np.int64)), pa.array(made[1]), pa.array(made[2]), pa.array(made[1] - made[2])]
        return pa.table(columns, ["row", *[name for name, _ in numbers]])

    with scratch_scope(docs.sparkSession) as scope:
        blocks = stage(in_blocks(flagged, block_bytes), "blocks")
        counts = stage(count(blocks, block_bytes), "counts")
        rests, shared = evidence(counts)
        known = counts.select("block", "gram").join(stage(rests, "evidence"), "gram")
        schema = StructType([blocks.schema["row"], *[StructField(*x) for x in numbers]])
        found = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
            scored, schema)
        return scope.keep(found.select("row.*", *[name for name, _ in numbers]), "scores")
