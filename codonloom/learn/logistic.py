"""Logistic regression with an elastic net, all penalties of a grid fitted in the same passes over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasElasticNetParam, HasFeaturesCol, HasLabelCol, HasRegParam
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.learn.kernel import MarginCurve, block_sums

SWEEPS = 500  # most rounds over the coordinates within a step
TRIED = 3  # rounds before signs are tried; each further try comes after twice as many


def penalized_step(slope: np.ndarray, bent: np.ndarray, at: np.ndarray, lasso: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Minima of quadratic models around `at` plus their penalties, by rounds over the coordinates, for all models at once.

    `lasso` and `ridge` hold a penalty for each model and coordinate (none for intercepts). A
    coordinate in which a model is flat stays. After a few rounds, and later again, the minimum
    is looked for from the signs found so far (see `minimum_by_signs`).
    """
    new, left = at.copy(), np.arange(len(at))
    tries = {TRIED * 2 ** i for i in range(10)}
    spot, pulls, curve, one, two = at.copy(), slope.copy(), bent, lasso, ridge
    for n in range(SWEEPS):
        own = np.diagonal(curve, axis1=1, axis2=2) + two
        usable, divisor = own > 1e-12, np.where(own > 1e-12, own, 1.0)
        largest = np.zeros(len(left))
        for j in range(at.shape[1]):
            pull = (own[:, j] - two[:, j]) * spot[:, j] - pulls[:, j]
            value = np.sign(pull) * np.maximum(np.abs(pull) - one[:, j], 0.0) / divisor[:, j]
            moved = np.where(usable[:, j], value - spot[:, j], 0.0)
            if moved.any():
                spot[:, j] += moved
                pulls += curve[:, :, j] * moved[:, None]
                largest = np.maximum(largest, np.abs(moved))
        done = largest < 1e-9
        if n + 1 in tries:
            for i in np.flatnonzero(~done):
                m = left[i]
                found = minimum_by_signs(slope[m], bent[m], at[m], lasso[m], ridge[m], spot[i])
                if found is not None:
                    spot[i], done[i] = found, True
        if done.any() or n == SWEEPS - 1:
            new[left] = spot
            keep = ~done
            left, spot, pulls, curve, one, two = (v[keep] for v in (left, spot, pulls, curve, one, two))
            if not len(left):
                break
    return new


def minimum_by_signs(slope: np.ndarray, bent: np.ndarray, at: np.ndarray, lasso: np.ndarray, ridge: np.ndarray, spot: np.ndarray) -> np.ndarray | None:
    """Minimum of one quadratic model plus penalty, from `spot` on, or nothing where the curvature leaves it open.

    With the signs given it is a linear system. A solution with other signs is approached up
    to the best of the points where signs change; a coordinate at zero whose slope exceeds its
    penalty comes in. Every such step lowers the value, so no signs are tried twice.
    """
    usable = np.diagonal(bent) + ridge > 1e-12
    whole, free = bent + np.diag(ridge), lasso == 0
    shift = bent @ at - slope  # the value is w.whole.w / 2 - shift.w + lasso.|w|, but for a constant
    spot, sign = spot.copy(), np.where(free, 0.0, np.sign(spot))

    def value(w: np.ndarray) -> np.ndarray:
        return ((w @ whole) * w).sum(1) / 2 - w @ shift + np.abs(w) @ lasso

    for _ in range(SWEEPS):
        inside = usable & (free | (sign != 0))
        block = whole[np.ix_(inside, inside)]
        unit = np.sqrt(np.diagonal(block))
        try:
            root = np.linalg.cholesky(block / np.outer(unit, unit))
        except np.linalg.LinAlgError:
            return None
        if (np.diagonal(root) < 1e-5).any():
            return None
        found = spot.copy()
        found[inside] = np.linalg.solve(block, (shift - whole @ np.where(inside, 0.0, spot) - lasso * sign)[inside])
        crossed = inside & (sign * found < 0)
        if crossed.any():
            step = found - spot
            stops = np.unique(np.append(-spot[crossed] / step[crossed], 1.0))
            points = spot + stops[:, None] * step
            values = value(points)
            best = values.argmin()
            if stops[best] <= 0 or values[best] >= value(spot[None])[0]:
                return None
            zero = crossed & (np.abs(-spot / np.where(step == 0, 1.0, step) - stops[best]) <= 1e-15)
            spot = np.where(zero, 0.0, points[best])
            sign = np.where(free, 0.0, np.sign(spot))
            continue
        spot = found
        pull = whole @ spot - shift
        over = np.where(usable & ~inside, np.abs(pull) - lasso * (1 + 1e-9), -1.0)
        if over.max() <= 0:
            return spot
        sign[over.argmax()] = -np.sign(pull[over.argmax()])
    return None


def elastic_nets(blocks: DataFrame, width: int, regs: list[float], shares: list[float], limit: int = 50) -> np.ndarray:
    """Weights and intercept, a row for each pair of a penalty and its share of absolute values.

    Each minimizes the mean logistic loss plus reg * (share * |w| + (1 - share) / 2 * w^2).
    A step is one pass: loss, slope and curvature of all models, whose quadratic models the
    driver minimizes with the penalty. A model whose value rose goes back half its step.
    """
    number, size = len(regs), width + 1
    reg, share = np.array(regs)[:, None], np.array(shares)[:, None]
    free = np.concatenate([np.ones((1, width)), np.zeros((1, 1))], 1)
    lasso, ridge = reg * share * free, reg * (1 - share) * free
    at = np.zeros((number, size))
    held, best = at, np.full(number, np.inf)
    for _ in range(limit):
        def derivatives(x, y, part, at=at):
            wide = np.concatenate([x, np.ones((len(x), 1))], 1)
            z = wide @ at.T
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            loss = np.logaddexp(0.0, z) - y[:, None] * z
            second = [wide.T @ (wide * v[:, None]) for v in (p * (1 - p)).T]
            return np.concatenate([[len(x)], loss.sum(0), ((p - y[:, None]).T @ wide).ravel(), np.ravel(second)])

        sums = block_sums(blocks, derivatives, 1 + number * (1 + size + size * size))
        n, sums = sums[0], sums[1:] / max(sums[0], 1.0)
        value = sums[:number] + (lasso * np.abs(at) + ridge * at * at / 2).sum(1)
        rose = value > best + 1e-12 * np.abs(best)
        done = ~rose & (best - value <= 1e-10 * np.abs(value))
        if not n or done.all():
            break
        slope = sums[number:number * (1 + size)].reshape(number, size)
        bent = sums[number * (1 + size):].reshape(number, size, size)
        step = penalized_step(slope, bent, at, lasso, ridge)
        held, best, at = np.where(rose[:, None], held, at), np.where(rose, best, value), np.where(rose[:, None], (held + at) / 2, step)
    return held if rose.any() else at


class ElasticNet(Estimator, HasFeaturesCol, HasLabelCol, HasRegParam, HasElasticNetParam, DefaultParamsReadable, DefaultParamsWritable):
    """Logistic regression whose penalty weighs the features as they come; several penalties share their passes."""

    fits_together = True

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="target", regParam=0.0, elasticNetParam=0.0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="target", regParam=0.0, elasticNetParam=0.0)
        self._set(**self._input_kwargs)

    def fitMultiple(self, dataset: DataFrame, paramMaps):
        return enumerate(self._fitted(dataset, [self.copy(m) for m in paramMaps]))

    def _fit(self, dataset: DataFrame) -> MarginCurve:
        return self._fitted(dataset, [self])[0]

    def _fitted(self, dataset: DataFrame, nets: list[ElasticNet]) -> list[MarginCurve]:
        def pack(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in arrived:
                if batch.num_rows:
                    held = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) if i else
                            batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float) for i in range(2)]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (*(h.tobytes() for h in held), b"")], ["x", "y", "part"])

        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        blocks = rows.mapInArrow(pack, "x binary, y binary, part binary").persist()
        try:
            first = blocks.select(F.length("x").alias("x"), F.length("y").alias("y")).first()
            if first is None:
                raise ValueError("no rows to fit")
            at = elastic_nets(blocks, first["x"] // first["y"], [n.getRegParam() for n in nets], [n.getElasticNetParam() for n in nets])
        finally:
            blocks.unpersist()
        return [MarginCurve(inputCol=self.getFeaturesCol(), weights=w[:-1].tolist(), intercept=float(w[-1])) for w in at]
