"""Hashed n-gram features of a text and a linear classifier over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Odd multipliers and a prime base; any such values would do.
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def char_grams(text: bytes, sizes: tuple[int, ...]) -> np.ndarray:
    """64-bit hashes of all byte n-grams of the given sizes, repeats included."""
    symbols = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    found, rolling = [], symbols
    for n in range(1, max(sizes) + 1):
        if n > len(symbols):
            break
        if n > 1:
            rolling = rolling[:-1] * _BASE + symbols[n - 1:]
        if n in sizes:
            found.append((rolling + np.uint64(n)) * _MIX)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def word_grams(words: list[bytes], sizes: tuple[int, ...]) -> np.ndarray:
    """64-bit hashes of all word n-grams of the given sizes, repeats included."""
    import xxhash

    single = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    found, rolling = [], single
    for n in range(1, max(sizes) + 1):
        if n > len(single):
            break
        if n > 1:
            rolling = rolling[:-1] * _BASE + single[n - 1:]
        if n in sizes:
            found.append((rolling + np.uint64(n)) * _MIX)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def distinct_bins(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The distinct leading `bits` bits of the hashes."""
    bins = (hashes >> np.uint64(64 - bits)).astype(np.int32)
    last = _scratch(bits)
    order = np.arange(len(bins), dtype=np.int32)
    last[bins] = order
    return bins[last[bins] == order]


_SCRATCH: dict[int, np.ndarray] = {}


def _scratch(bits: int) -> np.ndarray:
    if bits not in _SCRATCH:
        _SCRATCH[bits] = np.empty(1 << bits, np.int32)
    return _SCRATCH[bits]


@dataclass
class LinearModel:
    """score = sigmoid(slope * (bias + sum of weights) + shift).

    With `by_length` the sum is divided by the root of the number of features.
    """

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    by_length: bool = True

    def margin(self, bins: np.ndarray) -> float:
        total = float(self.weights[bins].sum(dtype=np.float64))
        return self.bias + (total / np.sqrt(max(1, len(bins))) if self.by_length else total)

    def score(self, bins: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(bins) + self.shift, -30, 30))))


class _Design:
    """Which wanted features the rows have, by row and by feature.

    Values are a row's factor times a feature's factor, so only places are held.
    """

    def __init__(self, rows: list[np.ndarray], wanted: np.ndarray):
        self.names = np.flatnonzero(wanted)
        number = np.cumsum(wanted, dtype=np.int32) - np.int32(1)
        used = [number[r[wanted[r]]] for r in rows]
        self.sizes = np.array([len(r) for r in used])
        self.column = np.concatenate(used)
        self.counts = np.bincount(self.column, minlength=len(self.names))
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), self.sizes)
        self.owner = owner[np.argsort(self.column, kind="stable")]

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of each row's features."""
        return _sums(values.astype(np.float32)[self.column], self.sizes)

    def per_feature(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of each feature's rows."""
        return _sums(values.astype(np.float32)[self.owner], self.counts)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes, some of them empty."""
    result, there = np.zeros(len(sizes)), sizes > 0
    if len(values):
        result[there] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[there])
    return result


def _logistic(rows, y, scale, l2: float, rounds: int, by_length: bool, settled: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and bias by accelerated gradient descent.

    At most `rounds` steps; it is over once ten steps running have moved no row's
    probability by `settled` or more.
    """
    x = _Design(rows, scale != 0)
    factor = scale[x.names]
    length = 1 / np.sqrt(np.maximum(1, [len(r) for r in rows])) if by_length else np.ones(len(rows))
    n, d = len(rows), len(x.names)
    # Steps per feature out of a bound on the curvature, so that rare features keep up.
    reach = length * x.per_row(np.abs(factor)) + 1
    step = 1 / (np.abs(factor) * x.per_feature(length * reach) / (4 * n) + l2 / n)
    step_b = 4 / reach.mean()
    w, b = np.zeros(d), 0.0
    v, c = w.copy(), b
    before, quiet = np.full(n, 0.5), 0
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(length * x.per_row(v * factor) + c, -30, 30)))
        quiet = quiet + 1 if np.abs(p - before).max() < settled else 0
        if quiet == 10:
            break
        before, gap = p, (p - y) / n
        w_new, b_new = v - step * (factor * x.per_feature(length * gap) + l2 * v / n), c - step_b * gap.sum()
        momentum = i / (i + 3)
        v, c = w_new + momentum * (w_new - w), b_new + momentum * (b_new - b)
        w, b = w_new, b_new
    weights = np.zeros(len(scale))
    weights[x.names] = w
    return weights * scale, b


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make margins of rows not trained on into probabilities."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = np.array([((p - target) * margin).sum(), (p - target).sum()]), p * (1 - p) + 1e-9
        m = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(m, g)
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
    return float(max(a, 1e-3)), float(b)


def log_count_ratio(rows, y: np.ndarray, bits: int, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratio of each bin and how many standard errors it is from zero."""
    size = 1 << bits
    one, zero = np.zeros(size), np.zeros(size)
    for r, label in zip(rows, y, strict=True):
        (one if label else zero)[r] += 1
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    p1, p0 = (one + smooth) / (n1 + 2 * smooth), (zero + smooth) / (n0 + 2 * smooth)
    pooled = (one + zero + smooth) / (n1 + n0 + 2 * smooth)
    return np.log(p1 / p0), np.abs(p1 - p0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int, *, by_ratio: bool, features: int, by_length: bool = True,
        l2: float = 1.0, rounds: int = 200, folds: int = 4, smooth: float = 1.0) -> LinearModel:
    """A calibrated classifier over the `features` bins that tell the classes apart best.

    `by_ratio` scales every feature by its naive Bayes log-count ratio. Bins are chosen and
    scaled on the training folds only, so the margins used for calibration are honest.
    With one class only, the score is that class's smoothed share.
    """
    y = np.asarray(y, float)

    def train(part_rows, part_y):
        ratio, z = log_count_ratio(part_rows, part_y, bits, smooth)
        least = np.partition(z, -features)[-features] if features < len(z) else 0.0
        scale = np.where((z >= max(least, 1e-9)), ratio if by_ratio else 1.0, 0.0) * np.sqrt(200.0 if by_length else 1.0)
        return _logistic(part_rows, part_y, scale, l2, rounds, by_length)

    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return LinearModel(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), by_length=by_length)
    fold, margin = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        w, b = train([rows[i] for i in inside], y[inside])
        held = LinearModel(w, b, by_length=by_length)
        for i in np.flatnonzero(fold == k):
            margin[i] = held.margin(rows[i])
    w, b = train(rows, y)
    return LinearModel(w.astype(np.float32), b, *_platt(margin, y), by_length)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, keep, max_rows: int) -> list[tuple[bytes, int]]:
    """Texts and 0/1 labels of at most `max_rows` labelled documents that pass `keep`.

    The sample is the same in every run: the rows with the smallest hash of their id.
    Contradicting labels of one id count as 1; null ids, labels and texts are left out.
    """
    known = labels.filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & keep)
    ranked = known.groupBy("doc_id").agg(F.max(target).alias("label"))
    chosen = ranked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows slim rows by construction, hence the broadcast.
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter("text is not null").join(
        F.broadcast(chosen), "doc_id")
    rows = found.select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.text)))
    return [(bytes(r.text), int(r.label)) for r in rows]
