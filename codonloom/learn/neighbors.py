"""Exact k nearest neighbours as a block nested-loop join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536  # training rows of a task
PROBE_ROWS = 8192  # and test rows
_CHUNK, _COLUMNS, _PAIRS = 512, 8192, 20_000  # test and training rows of one product, pairs measured exactly at a time


def lowest_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows in the order of their ids, of equal vectors the `k` lowest."""
    order = np.argsort(ids, kind="stable")
    _, same = np.unique(np.ascontiguousarray(x[order] + 0.0).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    by = np.argsort(same, kind="stable")
    start = np.flatnonzero(np.diff(same[by], prepend=-1))
    nth = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return order[np.sort(by[nth < k])]


def closest(x: np.ndarray, own: np.ndarray | None, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of `x`, row of `y`, distance) of the k nearest rows of `y`, ties by `ids`; rows whose id is in `own` skip themselves.

    Products in single precision and a bound on their error leave few pairs; those are measured
    exactly, so that neither rounding nor the order of rows decides.
    """
    kept = lowest_copies(y, ids, k + 1)
    y, ids = y[kept], ids[kept]
    wanted = k + (own is not None)
    far = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0))
    kind = np.float32 if far < 1e15 else np.float64
    square = (y * y).sum(1)
    right = np.concatenate([y, square[:, None]], 1).astype(kind).T
    error = (x.shape[1] + 8) * np.finfo(kind).eps * (2 * np.sqrt((x * x).sum(1) * square.max(initial=0.0)) + square.max(initial=0.0))
    found = []
    for low in range(0, len(x), _CHUNK):
        part, slack = x[low:low + _CHUNK], 2 * error[low:low + _CHUNK]
        left = np.concatenate([-2 * part, np.ones((len(part), 1))], 1).astype(kind)
        bound, picked = np.full(len(part), np.inf), []
        for at in range(0, len(y), _COLUMNS):
            gap = left @ right[:, at:at + _COLUMNS]
            if gap.shape[1] > wanted and not np.isfinite(bound).any():
                bound = np.partition(gap, wanted - 1, axis=1)[:, wanted - 1] + slack
            r, c = np.nonzero(gap <= bound[:, None])
            picked.append((r, c + at, gap[r, c]))
        r, c, gap = (np.concatenate(v) for v in zip(*picked, strict=True))
        order = np.lexsort((gap, r))
        r, c, gap = r[order], c[order], gap[order]
        start = np.searchsorted(r, np.arange(len(part) + 1))
        last = gap[np.minimum(start[:-1] + wanted, start[1:]).clip(1) - 1] if len(gap) else gap
        near = gap <= (last + slack)[r] if len(gap) else np.zeros(0, np.bool_)
        if own is not None:
            near &= own[low:low + _CHUNK][r] != ids[c]
        r, c = r[near], c[near]
        exact = np.concatenate([np.zeros(0), *(
            np.sqrt(((part[r[i:i + _PAIRS]] - y[c[i:i + _PAIRS]]) ** 2).sum(1)) for i in range(0, len(r), _PAIRS))])
        order = np.lexsort((ids[c], exact, r))
        nth = np.arange(len(r)) - np.searchsorted(r[order], r[order])
        order = order[(nth < k) & np.isfinite(exact[order])]
        found.append((r[order] + low, kept[c[order]], exact[order]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def nearest(train: DataFrame, test: DataFrame, k: int, features: str = "features",
            row_id: str = "row_id", label: str = "label", skip_same_id: bool = False,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k closest training rows of every test row, ties by training id.

    Training rows are hashed into blocks of about `block_rows` rows, test rows into blocks an
    eighth as large. Each pair of blocks is compared in one task by matrix products that
    return k rows per test row, and a ranked window with a limit merges those rows, so neither
    side is ever held whole anywhere and distances are never emitted. `features` is an array
    of doubles, `row_id` a bigint, `label` 0/1. Output: (row_id, distance, neighbor,
    neighbor_label, rank).
    """
    def blocks(df: DataFrame, rows: int):
        return df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.lit(1)).alias("n")).scalar()

    n_train, n_test = blocks(train, block_rows), blocks(test, max(1, block_rows * PROBE_ROWS // BLOCK_ROWS))

    def placed(df: DataFrame, own: str, n_own, other: str, n_other, columns) -> DataFrame:
        # New names on each side: both may come from one table, whose columns Spark would mix up.
        return df.select(
            *[F.col(c).alias(f"{own}_{c}") for c in columns], F.pmod(F.xxhash64(row_id), n_own).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), n_other.cast("long") - 1)).alias(other))

    left = placed(train, "a", n_train, "b", n_test, [row_id, features, label])
    right = placed(test, "b", n_test, "a", n_train, [row_id, features])

    def compared(block: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        if block.empty or probes.empty:
            return pd.DataFrame(columns=["row_id", "distance", "neighbor", "neighbor_label"])
        x, y = np.stack(probes[f"b_{features}"].to_numpy()), np.stack(block[f"a_{features}"].to_numpy())
        asked, ids = probes[f"b_{row_id}"].to_numpy(), block[f"a_{row_id}"].to_numpy()
        at, to, distance = closest(x, asked if skip_same_id else None, y, ids, k)
        return pd.DataFrame({
            "row_id": asked[at], "distance": distance, "neighbor": ids[to], "neighbor_label": block[f"a_{label}"].to_numpy()[to]})

    schema = "row_id bigint, distance double, neighbor bigint, neighbor_label int"
    short = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(compared, schema)
    closest_first = Window.partitionBy("row_id").orderBy("distance", "neighbor")
    return short.withColumn("rank", F.row_number().over(closest_first)).filter(F.col("rank") <= k)


def neighbor_scores(neighbors: DataFrame, k: int) -> DataFrame:
    """Share of positive labels among the k closest."""
    return (
        neighbors.filter(F.col("rank") <= k).groupBy("row_id")
        .agg(F.avg("neighbor_label").alias("score"))
    )


def neighbor_scores_by_k(neighbors: DataFrame, ks) -> DataFrame:
    """Scores for several k from one neighbour search."""
    settings = F.explode(F.array(*[F.lit(int(k)) for k in ks]))
    tagged = neighbors.withColumn("k", settings).filter(F.col("rank") <= F.col("k"))
    return tagged.groupBy("row_id", "k").agg(F.avg("neighbor_label").alias("score"))
