"""The exact first split against every cut by brute force."""

import numpy as np

from codonloom.learn import trees


def brute(x, y):
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        order = np.argsort(x[:, f], kind="stable")
        upto = np.searchsorted(x[order, f], values, side="right")
        hits = np.concatenate([[0], np.cumsum(y[order])])
        for v, following, l in zip(values[:-1], values[1:], upto[:-1], strict=True):
            l1, t, t1 = int(hits[l]), len(y), int(y.sum())
            r, r1 = t - int(l), t1 - l1
            impurity = (l / t) * 2 * (l1 / l) * (1 - l1 / l) + (r / t) * 2 * (r1 / r) * (1 - r1 / r)
            if best is None or impurity < best[0]:
                best = (impurity, f, (v + following) / 2, int(l), l1, r, r1)
    return best[1:]


def test_more_values_than_any_number_of_bins(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 3))
    x[:, 0] = x[:, 0].round(1)
    y = (x[:, 1] + rng.normal(size=len(x)) > 1.2345).astype(int)
    rows = [(int(a), *map(float, v)) for a, v in zip(y, x, strict=True)]
    data = spark.createDataFrame(rows, "y int, a double, b double, c double").repartition(4)
    got = trees.best_split(data, ("a", "b", "c"), "y", 1).collect()
    assert [tuple(r) for r in got] == [brute(x, y)]


def test_columns_without_a_cut(spark):
    data = spark.createDataFrame([(1, 2.0, None), (0, 2.0, 3.0)], "y int, a double, b double")
    assert trees.best_split(data, ("a", "b"), "y", 1).count() == 0
