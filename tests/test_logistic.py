"""Elastic nets fitted together against Spark's, one by one."""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector

from codonloom.learn.logistic import ElasticNet, penalized_step
from codonloom.learn.models import recipes


def test_nets_reach_the_weights_of_spark(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 4)) * [1.0, 3.0, 0.2, 0.0]
    x[:, 1] += x[:, 0]
    y = (x @ [1.0, -0.5, 2.0, 0.0] + 0.3 + rng.normal(size=1200) > 0).astype(float)
    frame = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)], "x array<double>, target double").select(
        array_to_vector("x").alias("features"), "target").repartition(3).cache()
    net = ElasticNet()
    grid = [{net.regParam: r, net.elasticNetParam: a} for r in (0.001, 0.01, 0.3) for a in (0.1, 1.0)]
    for params, model in zip(grid, net.fit(frame, grid), strict=True):
        known = LogisticRegression(labelCol="target", standardization=False, maxIter=500, tol=1e-12, regParam=params[net.regParam],
                                   elasticNetParam=params[net.elasticNetParam]).fit(frame)
        assert np.allclose(model.getOrDefault(model.weights), known.coefficients.toArray(), atol=1e-4)
        assert abs(model.getOrDefault(model.intercept) - known.intercept) < 1e-4
        ours, theirs = (np.array([r.probability[1] for r in m.transform(frame).collect()]) for m in (model, known))
        assert np.allclose(ours, theirs, atol=1e-4)


def test_a_fold_of_the_search_is_one_fit():
    assert recipes()["logistic_regression"].pipeline.getStages()[-1].fits_together


def test_a_step_over_correlated_features_ends_at_the_minimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 1)) + 0.02 * rng.normal(size=(400, 30))
    wide = np.concatenate([x, np.zeros((400, 1)), np.ones((400, 1))], 1)
    target = x[:, 0] - x[:, 1] + 0.5 * x[:, 2] + rng.normal(size=400)
    bent = np.stack([wide.T @ wide / 400] * 3)
    at = rng.normal(size=(3, 32)) * 0.1
    slope = np.stack([wide.T @ (wide @ a - target) / 400 for a in at])
    free = np.append(np.ones(31), 0.0)[None]
    lasso, ridge = np.array([[1e-4], [1e-3], [5e-3]]) * free, np.array([[1e-5], [1e-4], [0.0]]) * free
    new = penalized_step(slope, bent, at, lasso, ridge)
    pull = slope + np.einsum("mij,mj->mi", bent, new - at) + ridge * new
    off = np.where(new != 0, np.abs(pull + lasso * np.sign(new)), np.maximum(np.abs(pull) - lasso, 0.0))
    assert off[:, [*range(30), 31]].max() < 1e-9
    assert (new[:2, 30] == 0).all() and new[2, 30] == at[2, 30] and (new[:, :30] == 0).any()
