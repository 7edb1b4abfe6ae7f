"""Quality by regularised quadratic discriminant analysis of document statistics.

Every document becomes a short row of statistics, transformed to be roughly normal. Each class
gets a mean and a covariance that is shrunk towards the pooled covariance and the identity.
The difference of the two log densities (Mahalanobis distances through Cholesky factors that
are worked out once) is turned into a probability by a logistic curve fitted on margins of
rows the model had not seen. Class sums are added up on Spark over all labelled rows, so the
driver only ever holds sums.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonloom.llm.arrow import map_texts
from codonloom.llm.quality import SYMBOLS, repeated_words
from codonloom.session import stage

THRESHOLD = 0.3
FOLDS = 4
SHRINK = tuple((pooled, round_) for pooled in (0.02, 0.1, 0.3, 0.7) for round_ in (0.001, 0.01, 0.1))
STATISTICS = (
    "characters", "words", "word_length", "word_length_spread", "symbols", "marks", "upper", "digits", "blanks", "beyond_ascii",
    "line_words", "sentence_words", "distinct_words", "top_word", "distinct_pairs", "repeated_runs", "repeated_lines",
    "symbol_words", "upper_words", "one_letter_words", "same_as_before", "packed_size", "letter_entropy", "longest_word")
SIZE = len(STATISTICS)
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_UPPER, _LOWER, _DIGITS, _BLANKS = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58), (9, 14)))
_BIN, _BINS = 0.05, 600  # margins are counted in bins from -15 to 15 after compression


def _share(part: float, whole: float) -> float:
    """A share as a logit, kept off both ends."""
    s = (part + 0.05) / (whole + 0.1) if whole else 0.5
    return float(np.log(s / (1 - s))) if 0 < s < 1 else 0.0


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one whole text, in the order of `STATISTICS`."""
    words, n = text.split(), len(text)
    counts, m = Counter(words), len(words)
    lengths = np.fromiter(map(len, words), np.int64, m)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    held = letters[letters > 0] / max(1, n)
    inner = int(letters[0x80:0xC0].sum())  # continuation bytes of UTF-8
    ascii_letters = int(letters[65:91].sum() + letters[97:123].sum())
    pairs = len(set(zip(words, words[1:], strict=False)))
    sentences = sum(1 for w in words if w[-1:] in (b".", b"!", b"?"))
    return [
        np.log1p(n - inner), np.log1p(m), np.log1p(lengths.mean() if m else 0.0), np.log1p(lengths.std() if m else 0.0),
        _share(n - len(text.translate(None, SYMBOLS)), n), _share(n - len(text.translate(None, _MARKS)), n),
        _share(int(letters[65:91].sum()), ascii_letters), _share(int(letters[48:58].sum()), n),
        _share(int(letters[32] + letters[9:14].sum()), n), _share(int(letters[0xC0:].sum()), n - inner),
        np.log1p(m / max(1, len(lines))), np.log1p(m / (1 + sentences)),
        _share(len(counts), m), _share(max(counts.values(), default=0), m), _share(pairs, m - 1 if m > 1 else 0),
        _share(repeated_words(words), m), _share(len(lines) - len(set(lines)), len(lines)),
        _share(sum(c for w, c in counts.items() if w.translate(None, SYMBOLS) != w), m),
        _share(sum(c for w, c in counts.items() if w.isupper() and len(w) > 1), m), _share(int((lengths == 1).sum()), m),
        _share(sum(a == b for a, b in zip(words, words[1:], strict=False)), m - 1 if m > 1 else 0),
        _share(min(n, len(zlib.compress(text, 1))), n), float(-(held * np.log2(held)).sum()), np.log1p(int(lengths.max()) if m else 0)]


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `z`, the statistics, of every row; a null text is an empty one."""
    def work(texts: list[bytes]) -> list:
        z = np.array([statistics(t) for t in texts], np.float64).reshape(-1, SIZE)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * SIZE, pa.int32()), pa.array(z.ravel()))]

    return map_texts(docs, work, "z array<double>", keep)


def held_out() -> Column:
    """Rows kept for evaluation: crc32 of the id as text has remainder 0 by five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Sums:
    """Rows, sums and sums of products of one class."""

    n: float
    s: np.ndarray
    ss: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.s + other.s, self.ss + other.ss)

    def mean(self) -> np.ndarray:
        return self.s / max(1.0, self.n)

    def scatter(self) -> np.ndarray:
        return self.ss - np.outer(self.s, self.s) / max(1.0, self.n)


def _no_rows() -> Sums:
    return Sums(0.0, np.zeros(SIZE), np.zeros((SIZE, SIZE)))


@dataclass
class Normal:
    """A multivariate normal density with its factor cached: x'S^-1x is the squared length of `inverse` @ x."""

    mean: np.ndarray
    inverse: np.ndarray
    offset: float

    @staticmethod
    def of(mean: np.ndarray, covariance: np.ndarray, prior: float) -> Normal:
        factor = np.linalg.cholesky(covariance)
        return Normal(mean, np.linalg.inv(factor), float(np.log(prior) - np.log(np.diag(factor)).sum()))

    def log_density(self, z: np.ndarray) -> np.ndarray:
        """Log density of the rows of `z` plus log prior, but for a constant."""
        return self.offset - 0.5 * (((z - self.mean) @ self.inverse.T) ** 2).sum(1)


@dataclass
class Discriminant:
    """score = sigmoid(slope * squeezed(log density of good - of bad) + shift); one class only gives a constant."""

    good: Normal | None
    bad: Normal | None
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, z: np.ndarray) -> np.ndarray:
        if self.good is None:
            return np.zeros(len(z))
        gap = self.good.log_density(z) - self.bad.log_density(z)
        return np.sign(gap) * np.log1p(np.abs(gap))

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(z) + self.shift, -30, 30)))


def discriminant(good: Sums, bad: Sums, pooled_part: float, round_part: float) -> Discriminant:
    """Class covariances shrunk by `pooled_part` to the pooled one, then by `round_part` to its diagonal.

    The shrinkage target of the second step is the diagonal of the pooled covariance (the
    identity, once statistics are scaled), with a floor so that a constant statistic does no
    harm.
    """
    if good.n < 2 or bad.n < 2:
        return Discriminant(None, None)
    pooled = (good.scatter() + bad.scatter()) / (good.n + bad.n)
    target = np.diag(np.maximum(np.diag(pooled), 1e-4))

    def normal(c: Sums) -> Normal:
        own = (1 - pooled_part) * c.scatter() / c.n + pooled_part * pooled
        return Normal.of(c.mean(), (1 - round_part) * own + round_part * target, c.n / (good.n + bad.n))

    return Discriminant(normal(good), normal(bad))


def class_sums(rows: DataFrame) -> dict[tuple[int, int], Sums]:
    """Sums by (`fold`, `label`) of `rows` (fold, label, z); what returns to the driver does not depend on the number of rows."""
    def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Sums] = {}
        for batch in arrived:
            if batch.num_rows:
                z = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
                group = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
                for f, y in np.unique(group, axis=0).tolist():
                    part = z[(group == (f, y)).all(1)]
                    held[f, y] = held.get((f, y), _no_rows()) + Sums(len(part), part.sum(0), part.T @ part)
        place, value, fold, label = [], [], [], []
        for (f, y), s in held.items():
            flat = np.concatenate([[s.n], s.s, s.ss.ravel()])
            place.append(np.arange(len(flat)))
            value.append(flat)
            fold.append(np.full(len(flat), f))
            label.append(np.full(len(flat), y))
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (fold, label, place, value)], ["fold", "label", "place", "value"])

    total = rows.select("fold", "label", "z").mapInArrow(batches, "fold bigint, label bigint, place bigint, value double").groupBy(
        "fold", "label", "place").agg(F.sum("value").alias("value")).collect()
    found: dict[tuple[int, int], Sums] = {}
    for r in total:
        s = found.setdefault((r["fold"], r["label"]), _no_rows())
        at = r["place"]
        if at == 0:
            s.n = r["value"]
        elif at <= SIZE:
            s.s[at - 1] = r["value"]
        else:
            s.ss[divmod(at - 1 - SIZE, SIZE)] = r["value"]
    return found


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope, shift and mean log loss of the logistic curve through weighted margins."""
    total, good = weight.sum(), (weight * y).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (total - good + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        gap, h = weight * (p - target), weight * (p * (1 - p) + 1e-9)
        m = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(m, [(gap * x).sum(), gap.sum()])
        a, b = a - float(np.clip(move[0], -2, 2)), b - float(np.clip(move[1], -2, 2))
    a = max(a, 1e-3)
    p = np.clip(1 / (1 + np.exp(-np.clip(a * x + b, -30, 30))), 1e-9, 1 - 1e-9)
    return a, b, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / total)


def _margins(rows: DataFrame, models: dict[int, list[Discriminant]]) -> dict[int, np.ndarray]:
    """For each shrinkage setting how many rows of each label fall into each bin of margins of models without their fold."""
    def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(SHRINK), _BINS, 2), np.int64)
        for batch in arrived:
            if batch.num_rows:
                z = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
                fold, label = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
                for f in np.unique(fold).tolist():
                    inside = fold == f
                    for k, model in enumerate(models[f]):
                        at = np.clip(np.floor(model.margin(z[inside]) / _BIN) + _BINS // 2, 0, _BINS - 1).astype(np.int64)
                        np.add.at(held[k], (at, label[inside]), 1)
        k, at, y = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, at, y, held[k, at, y])], ["k", "bin", "label", "n"])

    counted = rows.select("fold", "label", "z").mapInArrow(batches, "k bigint, bin bigint, label bigint, n bigint").groupBy(
        "k", "bin", "label").agg(F.sum("n").alias("n")).collect()
    found = {k: np.zeros((_BINS, 2)) for k in range(len(SHRINK))}
    for r in counted:
        found[r["k"]][r["bin"], r["label"]] = r["n"]
    return found


def train(rows: DataFrame) -> Discriminant:
    """A calibrated discriminant from all of `rows` (key, label, z).

    Folds are dealt by a hash of the key. The shrinkage with the least loss on unseen folds is
    taken, and its margins there give the curve. With fewer than two rows of a class the score
    is the smoothed share of good rows.
    """
    dealt = rows.select(F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(FOLDS)).cast("bigint").alias("fold"), F.col("label").cast("bigint").alias("label"), "z")
    sums = class_sums(dealt)

    def over(label: int, without: int | None = None) -> Sums:
        return sum((s for (f, y), s in sums.items() if y == label and f != without), _no_rows())

    good, bad = over(1), over(0)
    if good.n < 2 or bad.n < 2:
        share = (good.n + 1) / (good.n + bad.n + 2)
        return Discriminant(None, None, 1.0, float(np.log(share / (1 - share))))
    models = {f: [discriminant(over(1, f), over(0, f), *s) for s in SHRINK] for f in range(FOLDS)}
    middle = (np.arange(_BINS) - _BINS // 2 + 0.5) * _BIN
    best = None
    for k, held in _margins(dealt, models).items():
        x, y, w = np.tile(middle, 2), np.repeat([0.0, 1.0], _BINS), np.concatenate([held[:, 0], held[:, 1]])
        slope, shift, loss = _curve(x[w > 0], y[w > 0], w[w > 0])
        if best is None or loss < best[0]:
            best = loss, k, slope, shift
    _, k, slope, shift = best
    final = discriminant(good, bad, *SHRINK[k])
    return Discriminant(final.good, final.bad, slope, shift)


def labelled(rows: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """`key`, `label` and `z` of the rows of `rows` (doc_id, z) that are labelled and not held out.

    Contradicting labels of one id count as 1; null ids and labels are left out. The labels
    are written first and joined without a hint.
    """
    known = labels.filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max(target).alias("label"))
    known = stage(known.select(F.col("doc_id").alias("key"), "label"), "labels")
    return rows.select("doc_id", "z").join(known, F.col("doc_id") == F.col("key")).select("key", "label", "z")


def score(rows: DataFrame, model: Discriminant, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `score` (probability of being good) of every row of `rows` (keep, z)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)

    def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            z = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(model.score(z))], [*keep, "score"])

    return rows.select(*keep, "z").mapInArrow(batches, f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, `held_out`, `score` and `predicted` of every row of `docs`.

    Null and empty texts have statistics like any text and get a score. Repeated rows are
    scored one by one; a null id is never held out nor trained on; other columns are not
    carried. Without labels all scores are one half.
    """
    rows = stage(measured(docs), "statistics")
    model = train(labelled(rows, labels))
    return score(rows, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
