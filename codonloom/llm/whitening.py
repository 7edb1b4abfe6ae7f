"""Whitening of vectors with the block matrices of MLlib.

Rows are centred and laid into the blocks of a distributed matrix. The transposed matrix times
the matrix is the scatter, whose eigenvectors are found locally (it is as large as a vector is
long, squared); the matrix times the scaled eigenvectors gives the whitened rows. Repeated
vectors count once in the fit, and every row is projected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonloom.llm.vectors import usable
from codonloom.session import stage

GRID, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_BYTES = 32 << 20  # largest block
RANK = 1e-12  # eigenvalues below this part of the trace are rounding


def to_grid(vector: str) -> Column:
    return F.transform(vector, lambda v: F.floor(v.cast("double") * GRID).cast("long") + SHIFT)


def rows_per_block(n: int, length: int) -> int:
    """Rows of a block: small tables fill several hundred blocks, large ones have blocks up to `BLOCK_BYTES`.

    The driver lists block numbers before it multiplies, hence the growth.
    """
    return max(1, min(max(64, min(2048, n // 512), n // 100_000), BLOCK_BYTES // (8 * length)))


@dataclass
class Blocks:
    """A written table (`block`, `x`, and a list per kept column) with one row per block of rows."""

    table: DataFrame
    size: int
    length: int
    keep: tuple[str, ...]
    count: int  # of block numbers, used or not


def blocks(rows: DataFrame, length: int, size: int, keep: tuple[str, ...] = (), name: str = "blocks") -> Blocks:
    """Rows with a vector `x` of longs, in blocks of at most `size` rows of one task.

    Every task numbers its own blocks, so nothing is shuffled and no number depends on
    another task; numbers without a block are blocks of zeros.
    """
    fields = [f for f in rows.select(*keep).schema.fields] if keep else []
    lists = "".join(f", `{f.name}` array<{f.dataType.simpleString()}>" for f in fields)

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        x = table.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        columns = [table.column(i + 1).combine_chunks() for i in range(len(keep))]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        held = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), *held], ["x", *keep])

    def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in arrived:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, size - n)
                held.append(piece)
                at, n = at + piece.num_rows, n + piece.num_rows
                if n == size:
                    yield made(held)
                    held, n = [], 0
        if held:
            yield made(held)

    packed = rows.select("x", *keep).mapInArrow(batches, f"x binary{lists}")
    written = stage(packed.withColumn("_place", F.monotonically_increasing_id()), name)
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    top = written.agg(F.max(part).alias("part"), F.max(inside).alias("inside")).first()
    per_task = (top["inside"] or 0) + 1
    numbered = written.select((part * per_task + inside).alias("block"), "x", *keep)
    return Blocks(numbered, size, length, keep, ((top["part"] or 0) + 1) * per_task)


def centred(rows: Blocks, n: int, sums: list[int]) -> BlockMatrix:
    """The distributed matrix of the rows less the mean; blocks with fewer rows end in rows of zeros."""
    size, length = rows.size, rows.length

    def dense(row) -> tuple[tuple[int, int], DenseMatrix]:
        x = np.frombuffer(row["x"], np.int64).reshape(-1, length)
        full = np.zeros((size, length))
        full[:len(x)] = (n * x - np.array(sums, np.int64)) / n
        return (row["block"], 0), DenseMatrix(size, length, full.T.ravel())

    return BlockMatrix(rows.table.select("block", "x").rdd.map(dense), size, length, rows.count * size, length)


def gram(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """The transposed matrix times the matrix, as a local array.

    The one block of the result is added up from `splits` partial products, so that no task
    meets all rows (the Python call has no argument for that, the method it wraps has).
    """
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


@dataclass
class Whitener:
    """Means as sums over `n` distinct vectors, eigenvalues (falling), unit eigenvectors (columns) and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def _scaled(spark, values: np.ndarray, vectors: np.ndarray) -> BlockMatrix:
    """Eigenvectors over the roots of their eigenvalues, as a matrix of one block."""
    w = vectors / np.sqrt(values)
    block = ((0, 0), DenseMatrix(*w.shape, w.T.ravel()))
    return BlockMatrix(spark.sparkContext.parallelize([block], 1), *w.shape, *w.shape)


def fit(rows: DataFrame, length: int, components: int = COMPONENTS) -> Whitener | None:
    """A whitener for the distinct vectors `x` of `rows`; none where nothing varies.

    Components beyond the rank of the covariance are left out, as they cannot be scaled.
    """
    spark = rows.sparkSession
    distinct = stage(rows.select("x").distinct(), "distinct")
    found = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum("v").alias("s"), F.count("*").alias("n")).collect()  # one row per dimension
    if not found:
        return None
    n, sums = found[0]["n"], [r["s"] for r in sorted(found, key=lambda r: r["i"])]
    laid = blocks(distinct, length, rows_per_block(n, length), name="fit_blocks")
    z = centred(laid, n, sums)
    splits = max(1, min(laid.count, laid.table.rdd.getNumPartitions()))
    scatter = gram(z, splits) / n
    scatter = (scatter + scatter.T) / 2
    values, vectors = np.linalg.eigh(scatter)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > RANK * max(np.trace(scatter), 1e-300)]
    if not len(order):
        return None
    values, vectors = values[order], vectors[:, order]
    # The columns of z add up to zero, and so do those of its product: the covariance needs no second centring.
    covariance = gram(z.multiply(_scaled(spark, values, vectors)), splits) / n
    return Whitener(n, sums, values, vectors, float(np.trace(scatter)), float(np.abs(covariance - np.eye(len(values))).max()))


def deviation(x: str, model: Whitener) -> Column:
    """Sum over dimensions of (n * x - sum)^2; null where it exceeds a long."""
    gaps = F.zip_with(x, F.array(*[F.lit(s).cast("long") for s in model.sums]), lambda v, s: v * F.lit(model.n).cast("long") - s)
    return F.aggregate(F.transform(gaps, lambda g: F.try_multiply(g, g)), F.lit(0).cast("long"), lambda a, b: F.try_add(a, b))


def project(rows: DataFrame, length: int, model: Whitener, key: str = "key") -> DataFrame:
    """`key`, `deviation` and `whitened` (list of the components) of every row of `rows` (key, x)."""
    spark = rows.sparkSession
    n = rows.count()
    laid = blocks(rows.select("x", key, deviation("x", model).alias("deviation")), length, rows_per_block(n, length),
                  (key, "deviation"), "all_blocks")
    product = centred(laid, model.n, model.sums).multiply(_scaled(spark, model.values, model.vectors))
    flat = product.blocks.map(lambda b: (b[0][0], bytearray(np.ascontiguousarray(b[1].toArray()).tobytes())))
    made = stage(spark.createDataFrame(flat, "number bigint, y binary"), "products")
    joined = laid.table.join(made, F.col("block") == F.col("number")).select(key, "deviation", "y")
    width = len(model.values)

    def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            for i in range(batch.num_rows):
                keys, gaps = batch.column(0)[i].values, batch.column(1)[i].values
                y = np.frombuffer(batch.column(2)[i].as_py(), np.float64).reshape(-1, width)[:len(keys)]
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * width, pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([keys, gaps, values], [key, "deviation", "whitened"])

    kind = rows.schema[key].dataType.simpleString()
    return joined.mapInArrow(batches, f"`{key}` {kind}, deviation bigint, whitened array<double>")


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """`key`, `component` (from 1), `n`, `deviation`, `whitened`, `explained` and `identity_error` of all usable rows.

    Which rows are usable says `vectors.usable`. Vectors are laid on a grid of 1/64 first.
    Repeated rows come out as often as they went in, null keys are kept, columns not named are
    not carried. Where fewer directions than `components` vary, there are fewer; with one
    distinct vector or none the result is empty.
    """
    good, length = usable(rows.select(F.col(key).alias("key"), F.col(vector).alias("v")), "v")
    grid = stage(good.select("key", to_grid("v").alias("x")), "grid")
    model = fit(grid, length, components) if length else None
    kind = rows.schema[key].dataType.simpleString()
    if model is None:
        return rows.sparkSession.createDataFrame(
            [], f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(v) / model.trace) for v in model.values])
    long = project(grid, length, model).select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))
