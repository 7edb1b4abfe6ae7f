"""Product codes of vectors, with nearest entries found through memoised grid cells.

A vector is cut into equal parts; each part becomes the number of the nearest entry of that
part's codebook. The space of a part is cut into boxes. For a box an entry is dominated when
its least distance to the box exceeds the largest distance of some other entry: whatever the
part inside, the other entry is nearer. The entries left are remembered by the hash of the
box, and only they are compared exactly. All arithmetic is in integers, so codes and codebooks
do not depend on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.llm.vectors import usable
from codonloom.session import stage

GRID = 4096  # steps per unit of a component
BOX = 1024  # width of a box, in steps
MEMORY = 1 << 16  # boxes a task remembers per part; beyond it they are worked out anew for each batch


def to_grid(vector: str) -> F.Column:
    return F.transform(vector, lambda v: F.floor(v.cast("double") * GRID).cast("long"))


class Memo:
    """Nearest entries of one part's codebook, with undominated entries remembered per box."""

    def __init__(self, entries: np.ndarray, box: int = BOX, memory: int = MEMORY):
        self.entries, self.box, self.memory = entries, box, memory
        self.held: dict[bytes, np.ndarray] = {}

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """For each cell (row of box numbers) which entries can be nearest to a part inside."""
        low = cells[:, None, :] * self.box
        high = low + self.box - 1
        below, above = low - self.entries[None], self.entries[None] - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
        most = (np.maximum(self.entries[None] - low, high - self.entries[None]) ** 2).sum(2)
        return least <= most.min(1, keepdims=True)

    def _candidates(self, cells: np.ndarray) -> np.ndarray:
        """Undominated entries of distinct cells, from memory where they are known."""
        names = [c.tobytes() for c in cells]
        new = [i for i, name in enumerate(names) if name not in self.held]
        found = np.zeros((len(cells), len(self.entries)), np.bool_)
        if new:
            found[new] = self.undominated(cells[new])
            if len(self.held) + len(new) > self.memory:
                self.held.clear()
            for i in new[:self.memory]:
                self.held[names[i]] = found[i].copy()
        fresh = set(new)
        for i, name in enumerate(names):
            if i not in fresh:
                found[i] = self.held.get(name) if name in self.held else self.undominated(cells[i:i + 1])[0]
        return found

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (of equally near ones the lowest) and squared distance of each row."""
        cells = np.ascontiguousarray(parts // self.box)
        packed = cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel()
        _, first, place = np.unique(packed, return_index=True, return_inverse=True)
        open_ = self._candidates(cells[first])
        best, number = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)
        for e in range(len(self.entries)):
            rows = np.flatnonzero(open_[place, e])
            gap = ((parts[rows] - self.entries[e]) ** 2).sum(1)
            nearer = gap < best[rows]
            best[rows[nearer]], number[rows[nearer]] = gap[nearer], e
        return number, best


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """Bounds of the parts; where the length cannot be cut evenly they differ by one component at most."""
    at = [i * length // parts for i in range(parts + 1)]
    return [(a, b) for a, b in zip(at, at[1:], strict=False) if b > a]


@dataclass
class Codebooks:
    """Entries of each part, with the bounds of the parts."""

    bounds: list[tuple[int, int]]
    entries: list[np.ndarray]

    def sha256(self) -> str:
        """Digest of all components by part, entry and position, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(str(int(v)) for book in self.entries for v in book.ravel()).encode()).hexdigest()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every used entry becomes the mean, rounded down, of the parts it is nearest to.

    Tasks return one row of sums per part and entry, so what comes back is as large as the
    codebooks whatever the number of rows.
    """
    width = max(b - a for a, b in books.bounds)

    def batches(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(e) for e in books.entries]
        sums = [np.zeros((len(e), e.shape[1]), np.int64) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        for batch in batches_:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                for p, (a, b) in enumerate(books.bounds):
                    part = np.ascontiguousarray(x[:, a:b])
                    number, _ = memos[p].nearest(part)
                    np.add.at(sums[p], number, part)
                    counts[p] += np.bincount(number, minlength=len(counts[p]))
        used = [(p, e) for p in range(len(sums)) for e in np.flatnonzero(counts[p])]
        values = [sums[p][e].tolist() + [0] * (width - sums[p].shape[1]) for p, e in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in used], pa.int32()), pa.array([int(e) for _, e in used], pa.int32()),
             pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
             *[pa.array([v[i] for v in values], pa.int64()) for i in range(width)]],
            ["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    schema = "part int, entry int, n bigint, " + ", ".join(f"s{i} bigint" for i in range(width))
    total = rows.select("x").mapInArrow(batches, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    new = [e.copy() for e in books.entries]
    for r in total.collect():  # parts x entries rows
        a, b = books.bounds[r["part"]]
        new[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(b - a)]
    return Codebooks(books.bounds, new)


def train(rows: DataFrame, length: int, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks:
    """Codebooks fitted on every row of `rows` (key, x), which should be a written table.

    They start as the parts of the rows with the smallest keys (nulls last, equal keys by
    vector); with fewer rows than `entries` they are as small as that. Entries no part is
    nearest to stay as they are.
    """
    first = [r["x"] for r in rows.orderBy(F.col("key").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    bounds = cuts(length, parts)
    start = np.array(first, np.int64).reshape(len(first), length)
    books = Codebooks(bounds, [np.ascontiguousarray(start[:, a:b]) for a, b in bounds])
    for _ in range(rounds if first else 0):
        books = _refined(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("key",)) -> DataFrame:
    """`keep` columns, `code` (two hex digits per part) and `error` (squared distance to the entries) of every row."""
    kept = rows.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def batches(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(e) for e in books.entries]
        for batch in batches_:
            if batch.num_rows:
                x = _matrix(batch.column(len(keep)))
                numbers, error = np.zeros((len(x), len(memos)), np.uint8), np.zeros(len(x), np.int64)
                for p, (a, b) in enumerate(books.bounds):
                    number, gap = memos[p].nearest(np.ascontiguousarray(x[:, a:b]))
                    numbers[:, p], error = number, error + gap
                codes = [row.tobytes().hex() for row in numbers]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in range(len(keep))], pa.array(codes), pa.array(error)], [*keep, "code", "error"])

    return rows.select(*keep, "x").mapInArrow(batches, f"{fields}, code string, error bigint")


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8,
             entries: int = 16, rounds: int = 6) -> tuple[DataFrame, Codebooks]:
    """`key`, `label`, `code`, `error` and `label_error` (errors summed over equal labels) of all usable rows, and the codebooks.

    Which rows are usable says `vectors.usable`. At most 256 entries. Null keys and labels are
    values like any other (null labels are one group); repeated rows are coded one by one;
    columns not named are not carried. An empty table has an empty result.
    """
    good, length = usable(rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v")), "v")
    grid = stage(good.select("key", "label", to_grid("v").alias("x")), "grid")
    books = train(grid, length, parts, entries, rounds)
    coded = stage(encode(grid, books, ("key", "label")), "codes")
    # Sums first, so a label on a third of all rows meets one row here; written, so that Spark knows its size.
    sums = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label_errors")
    full = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return full.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error"), books
