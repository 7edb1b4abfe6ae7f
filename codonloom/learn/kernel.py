"""A radial kernel machine with class probabilities, from landmarks and a linear margin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasRegParam
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0.0)


def width_from(sample: np.ndarray) -> float:
    """Kernel width: mean of the inverse 0.1 and 0.9 quantiles of the squared distances of sampled pairs."""
    far = squared_distances(sample, sample)[np.triu_indices(len(sample), 1)]
    far = far[far > 0]
    return float(np.mean(1 / np.quantile(far, [0.1, 0.9]))) if len(far) else 1.0


def sampled(dataset: DataFrame, column: str, most: int) -> np.ndarray:
    """At most `most` different vectors, the same in every run: those with the lowest hash.

    Of large tables only rows in a share of the hash values are looked at, chosen so that
    some 64 times as many rows as wanted remain.
    """
    part = max(1, dataset.count() // (64 * most))
    hashed = dataset.select(vector_to_array(column).alias("x")).withColumn("h", F.xxhash64("x"))
    rows = hashed.filter(F.pmod("h", F.lit(part)) == 0).distinct().orderBy("h", "x").limit(most).collect()
    return np.array([r["x"] for r in rows], float)


class NystroemModel(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Vectors whose inner products approximate the kernel, exactly so between landmarks."""

    landmarks = Param(Params._dummy(), "landmarks", "landmark vectors, one after the other", TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "inverse root of the landmarks' kernel matrix, row by row", TypeConverters.toListFloat)
    size = Param(Params._dummy(), "size", "number of landmarks", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="kernel_features", landmarks=None, weights=None, size=None, gamma=None):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="kernel_features")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, gamma = self.getOrDefault(self.size), self.getOrDefault(self.gamma)
        marks = np.array(self.getOrDefault(self.landmarks)).reshape(size, -1)
        weights = np.array(self.getOrDefault(self.weights)).reshape(size, -1)

        @F.pandas_udf("array<double>")
        def project(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.exp(-gamma * squared_distances(np.stack(batch.to_numpy()), marks)) @ weights))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol()))))


class Nystroem(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Nystroem features of the kernel exp(-gamma * |x - y|^2) over at most `size` landmarks.

    Without a `gamma` the width comes from the landmarks' distances. Landmarks are a bounded
    sample, so the driver holds `size` vectors and a matrix of `size` squared.
    """

    size = Param(Params._dummy(), "size", "most landmarks", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width; 0 takes it from the data", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="kernel_features", size=128, gamma=0.0):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="kernel_features", size=128, gamma=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NystroemModel:
        marks = sampled(dataset, self.getInputCol(), self.getOrDefault(self.size))
        gamma = self.getOrDefault(self.gamma) or width_from(marks)
        values, vectors = np.linalg.eigh(np.exp(-gamma * squared_distances(marks, marks)))
        usable = values > 1e-10 * values.max()
        weights = vectors[:, usable] / np.sqrt(values[usable])
        return NystroemModel(
            inputCol=self.getInputCol(), outputCol=self.getOutputCol(), landmarks=marks.ravel().tolist(),
            weights=weights.ravel().tolist(), size=len(marks), gamma=gamma)


SMOOTHING = (1.5, 0.5, 0.1)  # half widths of the hinge's rounded corner, one after the other; at the first, rows with margin 0 are inside
# Dampings of a Newton step, in units of the mean curvature, and shares of it, that are tried at once.
STEPS = ((1e-12, 1.0), (1e-12, 0.5), (1e-6, 1.0), (1e-4, 1.0), (1e-3, 1.0), (1e-2, 1.0), (1e-1, 1.0), (1.0, 1.0))


def block_sums(blocks: DataFrame, work, size: int) -> np.ndarray:
    """Sum over all blocks of the vector of `size` numbers that `work(x, y, part)` returns for one."""
    def partial(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in arrived:
            for x, y, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                target = np.frombuffer(y)
                total += work(np.frombuffer(x).reshape(len(target), -1), target, np.frombuffer(part, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def added(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in arrived:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    # One short vector a partition meets the others in one task.
    found = blocks.mapInArrow(partial, "total binary").repartition(1).mapInArrow(added, "total binary").collect()
    return np.frombuffer(found[0]["total"]).copy() if found else np.zeros(size)


def _hinge(z: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hinge loss with a corner rounded over 1 - h to 1 + h, its slope, and where it is curved (by 1 / 2h)."""
    bend = np.clip(1 + h - z, 0.0, 2 * h)
    return bend * bend / (4 * h) + np.maximum(1 - h - z, 0.0), -bend / (2 * h), (bend > 0) & (bend < 2 * h)


def margins(blocks: DataFrame, width: int, left_out: list[int], regs: list[float], limit: int = 5) -> np.ndarray:
    """Linear hinge margins, a row of weights and an intercept for each pair of a part left out (-1: none) and a regularization.

    All are fitted at once by Newton steps, at most `limit` for each smoothing: two passes over the rows a step, whatever the
    number of margins. Weights
    are regularized in units of the deviations of the rows a margin is fitted on.
    """
    held, strength = np.repeat(left_out, len(regs)), np.tile(regs, len(left_out))
    number, size = len(held), width + 1

    def moments(x, y, part):
        rows = [part != i for i in left_out]
        return np.concatenate([np.concatenate([[r.sum()], x[r].sum(0), (x[r] ** 2).sum(0)]) for r in rows])

    seen = block_sums(blocks, moments, len(left_out) * (1 + 2 * width)).reshape(len(left_out), -1)
    n = np.maximum(seen[:, :1], 1.0)
    spread = np.maximum((seen[:, 1 + width:] - seen[:, 1:1 + width] ** 2 / n) / np.maximum(n - 1, 1.0), 0.0)
    n, spread = (np.repeat(v, len(regs), axis=0) for v in (n[:, 0], spread))
    ridge = strength[:, None] * np.concatenate([spread, np.zeros((number, 1))], 1)
    unit = np.concatenate([np.where(spread > 0, np.sqrt(spread), 1.0), np.ones((number, 1))], 1)
    at = np.zeros((number, size))
    for h in SMOOTHING:
        before = np.full(number, np.inf)
        for _ in range(limit):
            def curvature(x, y, part, at=at, h=h):
                wide, sign = np.concatenate([x, np.ones((len(x), 1))], 1), 2 * y - 1
                loss, slope, bent = _hinge(sign[:, None] * (wide @ at.T), h)
                used = part[:, None] != held[None]
                first = wide.T @ (np.where(used, slope, 0.0) * sign[:, None])
                second = [wide[m].T @ wide[m] / (2 * h) for m in (bent & used).T]
                return np.concatenate([np.where(used, loss, 0.0).sum(0), first.T.ravel(), np.ravel(second)])

            sums = block_sums(blocks, curvature, number * (1 + size + size * size))
            value = sums[:number] / n + (ridge * at * at).sum(1) / 2
            if (before - value <= 1e-4 * np.abs(value)).all():
                break
            before = value
            slope = sums[number:number * (1 + size)].reshape(number, size) / n[:, None] + ridge * at
            bent = sums[number * (1 + size):].reshape(number, size, size) / n[:, None, None]
            # Solved in units of the deviations, where the ridge is the same in all directions.
            bent = (bent + np.eye(size) * ridge[:, None, :]) / (unit[:, :, None] * unit[:, None, :])
            mean = 1e-9 + np.trace(bent, axis1=1, axis2=2)[:, None, None] / size
            tried = np.stack([
                at - t * np.linalg.solve(bent + d * mean * np.eye(size), (slope / unit)[:, :, None])[:, :, 0] / unit for d, t in STEPS])

            def objective(x, y, part, tried=tried, h=h):
                sign = (2 * y - 1)[:, None]
                used = part[:, None] != held[None]
                return np.concatenate([np.where(used, _hinge(sign * (x @ w[:, :-1].T + w[:, -1]), h)[0], 0.0).sum(0) for w in tried])

            values = block_sums(blocks, objective, len(STEPS) * number).reshape(len(STEPS), number) / n + (ridge * tried * tried).sum(2) / 2
            best = values.argmin(0)
            better = values[best, np.arange(number)] < value
            at = np.where(better[:, None], tried[best, np.arange(number)], at)
    return at


def curves(blocks: DataFrame, at: np.ndarray, folds: int, limit: int = 25) -> np.ndarray:
    """Slope and shift of a logistic curve over the margins of rows left out, a row for each regularization."""
    regs = len(at) // folds
    weights = at.reshape(folds, regs, -1)
    found = np.zeros((regs, 2))
    for _ in range(limit):
        def derivatives(x, y, part, found=found):
            m = np.zeros((len(x), regs))
            for i in range(folds):
                m[part == i] = x[part == i] @ weights[i, :, :-1].T + weights[i, :, -1]
            p = 1 / (1 + np.exp(-np.clip(m * found[:, 0] + found[:, 1], -500, 500)))
            off, v = p - y[:, None], p * (1 - p)
            return np.concatenate([(off * m).sum(0), off.sum(0), (v * m * m).sum(0), (v * m).sum(0), v.sum(0)])

        a, b, aa, ab, bb = block_sums(blocks, derivatives, 5 * regs).reshape(5, regs)
        aa, bb = aa + 1e-6, bb + 1e-6
        whole = aa * bb - ab * ab
        step = np.stack([(bb * a - ab * b) / whole, (aa * b - ab * a) / whole], 1)
        found = found - step / np.maximum(1.0, np.abs(step).max(1, keepdims=True) / 5)
        if np.abs(step).max() < 1e-8:
            break
    return found


class MarginCurve(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Class probabilities out of a linear margin and a logistic curve over it."""

    weights = Param(Params._dummy(), "weights", "weights of the margin", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept of the margin", TypeConverters.toFloat)
    slope = Param(Params._dummy(), "slope", "slope", TypeConverters.toFloat)
    shift = Param(Params._dummy(), "shift", "shift", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol="kernel_features", outputCol="probability", weights=None, intercept=0.0, slope=1.0, shift=0.0):
        super().__init__()
        self._setDefault(inputCol="kernel_features", outputCol="probability", intercept=0.0, slope=1.0, shift=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = np.array(self.getOrDefault(self.weights))
        intercept, slope, shift = (self.getOrDefault(p) for p in (self.intercept, self.slope, self.shift))

        @F.pandas_udf("array<double>")
        def probability(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=object)
            p = 1 / (1 + np.exp(-np.clip(slope * (np.stack(batch.to_numpy()) @ weights + intercept) + shift, -500, 500)))
            return pd.Series(list(np.stack([1 - p, p], 1)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(probability(vector_to_array(self.getInputCol()))))


class CalibratedMargin(Estimator, HasFeaturesCol, HasLabelCol, HasRegParam, DefaultParamsReadable, DefaultParamsWritable):
    """A linear hinge margin with a logistic curve fitted on margins of rows left out of training.

    Three folds by a hash of the features give the margins; the model itself sees all rows.
    Several regularizations are fitted in the same passes over the rows, the folds' margins, too.
    """

    folds = 3
    fits_together = True

    @keyword_only
    def __init__(self, *, featuresCol="kernel_features", labelCol="target", regParam=0.01):
        super().__init__()
        self._setDefault(featuresCol="kernel_features", labelCol="target", regParam=0.01)
        self._set(**self._input_kwargs)

    def fitMultiple(self, dataset: DataFrame, paramMaps):
        machines = [self.copy(m) for m in paramMaps]
        return enumerate(self._fitted(dataset, [m.getRegParam() for m in machines]))

    def _fit(self, dataset: DataFrame) -> MarginCurve:
        return self._fitted(dataset, [self.getRegParam()])[0]

    def _fitted(self, dataset: DataFrame, regs: list[float]) -> list[MarginCurve]:
        features, label = self.getFeaturesCol(), self.getLabelCol()
        x = vector_to_array(features)

        def pack(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in arrived:
                if batch.num_rows:
                    held = [batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float),
                            batch.column(1).to_numpy(zero_copy_only=False).astype(float),
                            batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in held], ["x", "y", "part"])

        rows = dataset.select(x.alias("x"), F.col(label).cast("double").alias("y"), F.pmod(F.xxhash64(x), F.lit(self.folds)).alias("part"))
        blocks = rows.mapInArrow(pack, "x binary, y binary, part binary").persist()
        try:
            first = blocks.select(F.length("x").alias("x"), F.length("y").alias("y")).first()
            if first is None:
                raise ValueError("no rows to fit")
            at = margins(blocks, first["x"] // first["y"], [*range(self.folds), -1], regs)
            found = curves(blocks, at[:self.folds * len(regs)], self.folds)
        finally:
            blocks.unpersist()
        return [MarginCurve(inputCol=features, weights=w[:-1].tolist(), intercept=float(w[-1]), slope=float(c[0]), shift=float(c[1]))
                for w, c in zip(at[self.folds * len(regs):], found, strict=True)]
