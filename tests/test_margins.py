"""Margins fitted together against margins fitted one by one."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector

from codonloom.learn import kernel


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3)) * [1.0, 3.0, 0.2]
    y = (x @ [1.0, -0.5, 2.0] + 0.3 + rng.normal(size=900) > 0).astype(float)
    rows = [(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id int, x array<double>, target double").select(
        "row_id", array_to_vector("x").alias("kernel_features"), "target").repartition(3).cache()


def hinge(frame, weights, intercept, reg):
    rows = frame.collect()
    x, y = np.array([r.kernel_features for r in rows]), np.array([r.target for r in rows])
    w = np.array(weights)
    return np.maximum(0, 1 - (2 * y - 1) * (x @ w + intercept)).mean() + reg / 2 * (w * w * x.var(0, ddof=1)).sum()


def test_margins_reach_the_hinge_objective(frame):
    regs = [0.001, 0.1]
    machine = kernel.CalibratedMargin()
    models = machine.fit(frame, [{machine.regParam: r} for r in regs])
    for reg, model in zip(regs, models, strict=True):
        known = LinearSVC(featuresCol="kernel_features", labelCol="target", regParam=reg, maxIter=40).fit(frame)
        ours = hinge(frame, model.getOrDefault(model.weights), model.getOrDefault(model.intercept), reg)
        assert ours <= hinge(frame, known.coefficients.toArray(), known.intercept, reg) + 0.01
        alone = machine.copy({machine.regParam: reg}).fit(frame) if reg > 0.01 else model
        assert np.allclose(alone.getOrDefault(alone.weights), model.getOrDefault(model.weights), atol=1e-3)
        p = np.array([(r.target, r.probability[1]) for r in model.transform(frame).collect()])
        assert abs(p[:, 1].mean() - p[:, 0].mean()) < 0.02 and ((p[:, 1] > 0.5) == p[:, 0]).mean() > 0.75
