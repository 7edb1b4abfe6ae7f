"""The quadratic discriminant against densities worked out the plain way, and on held-out rows."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonloom.llm import discriminant, entries

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_margins_are_log_density_differences():
    rng = np.random.default_rng(4)
    size = discriminant.SIZE
    good, bad = rng.normal(size=(300, size)), rng.normal(1, 2, size=(100, size))
    sums = [discriminant.Sums(len(z), z.sum(0), z.T @ z) for z in (good, bad)]
    model = discriminant.discriminant(*sums, 0.3, 0.1)
    pooled = ((good - good.mean(0)).T @ (good - good.mean(0)) + (bad - bad.mean(0)).T @ (bad - bad.mean(0))) / 400

    def log_density(x, z, prior):
        own = 0.9 * (0.7 * np.cov(z.T, bias=True) + 0.3 * pooled) + 0.1 * np.diag(np.diag(pooled))
        gap = x - z.mean(0)
        return np.log(prior) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * gap @ np.linalg.inv(own) @ gap

    x = rng.normal(size=(20, size))
    want = np.array([log_density(r, good, 0.75) - log_density(r, bad, 0.25) for r in x])
    assert np.allclose(model.margin(x), np.sign(want) * np.log1p(np.abs(want)))


def test_class_sums_on_spark(spark):
    z = np.random.default_rng(1).normal(size=(200, discriminant.SIZE))
    rows = spark.createDataFrame([(i % 4, i % 2, z[i].tolist()) for i in range(200)], "fold bigint, label bigint, z array<double>").repartition(5)
    for (f, y), s in discriminant.class_sums(rows).items():
        part = z[[i for i in range(200) if (i % 4, i % 2) == (f, y)]]
        assert s.n == len(part) and np.allclose(s.s, part.sum(0)) and np.allclose(s.ss, part.T @ part)
    assert discriminant.class_sums(rows.limit(0)) == {}


@needs_tables
def test_quality_of_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = entries.op12_quality_discriminant(spark, FOLDER).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id in labels]
    good, bad = [[r.score for r in unseen if labels[r.doc_id] == y] for y in (1, 0)]
    assert len(good) > 30 and len(bad) > 5
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s >= 0.3 for s in bad]) < 0.2


@needs_tables
def test_scores_see_no_held_out_label_and_no_other_column(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    before = {r.doc_id: r.score for r in discriminant.classify(docs, labels).collect()}
    turned = labels.withColumn("quality", F.when(discriminant.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    after = {r.doc_id: r.score for r in discriminant.classify(other, turned).collect()}
    assert before.keys() == after.keys() and all(abs(before[d] - after[d]) < 1e-6 for d in before)


def test_awkward_rows(spark):
    long = "lorem ipsum dolor " * 40_000
    rows = [(1, "some words here."), (2, None), (3, ""), (4, " \n\t "), (None, "no id"), (6, long), (6, long), (7, "é" * 50), (8, "&&& ||| ###")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("z", "key", "label", "score", "fold")})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (6, 1), (7, 1), (8, 0), (9, 5)], "doc_id bigint, quality int")
    got = discriminant.classify(docs.repartition(3), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 6}) == 1
    nothing = discriminant.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5} and len(nothing) == len(rows)
    assert discriminant.classify(docs.limit(0), labels).count() == 0
    assert all(np.isfinite(discriminant.statistics(t)).all() for t in (b"", b" ", b"a", long.encode(), b"\xff\xfe"))
