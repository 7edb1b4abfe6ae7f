"""The neighbour index against exact neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonloom.learn import neighbor_index as ni
from codonloom.learn.evaluate import auc
from codonloom.learn.search import areas, best_of, mean_areas
from codonloom.operators.sampling import assign_folds

SCHEMA = "row_id bigint, features array<double>, label int"


def clustered(n, d=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d)) * 4
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, d)) * [1.0, 5.0, *[1.0] * (d - 2)]
    x[: n // 3] = x[0]  # a vector that a third of the rows share
    return x, (x[:, 0] > 0).astype(int)


def exact(x, queries, k, scale):
    a, b = x / scale, queries / scale
    gap = ((b[:, None] - a[None]) ** 2).sum(2)
    return np.lexsort((np.broadcast_to(np.arange(len(x)), gap.shape), gap.round(9)), axis=1)[:, :k]


def test_recall_and_scale_of_a_bucketed_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ni, "BUCKET_ROWS", 64)
    everything, labels = clustered(3300)
    order = np.random.default_rng(1).permutation(3300)
    x, y, queries = everything[order[:3000]], labels[order[:3000]], everything[order[3000:]]
    train = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(3000)], SCHEMA).repartition(4)
    index = ni.fit(train, str(tmp_path / "index"), k=10, bucket_rows=64)
    scale = x.std(axis=0, ddof=1)
    assert np.allclose(index.scale, scale) and index.bits >= 4 and index.recall >= 0.95
    asked = spark.createDataFrame([(i, q.tolist(), 0) for i, q in enumerate(queries)], SCHEMA)
    again = ni.load(spark, str(tmp_path / "index"))
    assert again == index
    found = {}
    for r in ni.search(again, asked, 10).collect():
        found.setdefault(r.row_id, {})[r.rank] = (r.neighbor, r.neighbor_label)
    want = exact(x, queries, 10, scale)
    assert set(found) == set(range(300)) and all(sorted(f) == list(range(1, 11)) for f in found.values())
    hits = [len({n for n, _ in found[i].values()} & set(want[i].tolist())) for i in range(300)]
    assert np.mean(hits) / 10 >= 0.95
    assert all(y[n] == label for f in found.values() for n, label in f.values())
    # The shared vector is found by its lowest ids, and only k + 1 of its rows are kept.
    shared = np.flatnonzero((x == everything[0]).all(1))
    asks = next(i for i in range(300) if (queries[i] == everything[0]).all())
    assert [found[asks][r][0] for r in range(1, 11)] == shared[:10].tolist()
    assert index.rows(spark).select("row_id").distinct().count() == 3000 - len(shared) + 11
    with pytest.raises(ValueError):
        ni.search(index, asked, 11)
    with pytest.raises(ValueError):
        ni.search(index, asked.withColumn("features", F.slice("features", 1, 3)), 5)


def test_small_index_is_exact(spark, tmp_path):
    x, y = clustered(200, seed=2)
    train = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(200)], SCHEMA).repartition(3)
    index = ni.fit(train, str(tmp_path / "index"), k=7)
    assert index.bits == 0 and index.tables == 1 and index.recall == 1.0
    own = ni.search(index, train, 6, skip_same_id=True).collect()
    assert len(own) == 1200 and all(r.row_id != r.neighbor for r in own)
    assert ni.search(index, train.limit(0), 5).count() == 0
    flat = ni.fit(train.limit(0), str(tmp_path / "empty"))
    assert flat.width == 0 and flat.rows(spark).count() == 0


def test_folds_are_searched_without_themselves(spark):
    x, y = clustered(240, d=3, seed=3)
    rows = spark.createDataFrame([(i, x[i].tolist(), "driver" if y[i] else "passenger") for i in range(240)], "row_id bigint, features array<double>, y string")
    data = assign_folds(rows, "y", ["row_id"], 3).cache()
    ks = (5, 9)
    made = ni.fold_predictions(data, label="y", ks=ks, k=3, positive="driver").collect()
    fold = {r.row_id: r.fold for r in data.collect()}
    assert sorted((r.setting, r.row_id) for r in made) == [(s, i) for s in (0, 1) for i in range(240)]
    got = {(r.setting, r.row_id): r.score for r in made}
    for f in range(3):
        inside, held = ([i for i in range(240) if (fold[i] == f) == own] for own in (False, True))
        near = exact(x[inside], x[held], 9, x[inside].std(axis=0, ddof=1))
        for s, k in enumerate(ks):
            for i, row in zip(held, near, strict=True):
                assert got[s, i] == pytest.approx(np.mean([y[inside[j]] for j in row[:k]]))
    table = spark.createDataFrame(made)
    means = mean_areas(areas(table, "driver"))
    assert means.count() == 2 and best_of(means) in (0, 1) and auc(table, "obs", "score").first().auc > 0.8
