"""What the evaluation report trains, and how test tables are scored once for both of their reports."""

from collections import Counter

from pyspark.sql import functions as F

from codonloom.catalog import learning, registry
from codonloom.learn.models import recipes
from codonloom.operators.sampling import mark_undersample, undersample
from codonloom.sources.schemas import ALL_FEATURES


def test_the_report_holds_all_models_with_all_settings(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(learning, "_study_tables", lambda t: ("train", "test", "bench"))
    monkeypatch.setattr(learning, "train_and_report", lambda train, tests, models, *a, **more: asked.update(models=models, tests=tests, **more))
    registry.registered()["evaluation_report"](spark, "/nowhere")
    every = recipes(label="class")
    assert {m.name for m in asked["models"]} == set(every) and len(every) == 6
    assert all(len(m.grid) == len(every[m.name].grid) and m.variants == every[m.name].variants for m in asked["models"])
    assert set(asked["neighbors"]) == set(ALL_FEATURES) and asked["k"] == 10
    assert asked["rivals"] == {"benchmark": "competitor_score"} and set(asked["tests"]) == {"test", "benchmark"}


def test_marked_rows_are_those_undersampling_keeps(spark):
    rows = spark.range(200).select(
        F.when(F.col("id") % 50 != 0, F.col("id") % 90).alias("row_id"),
        F.when(F.col("id") % 40 != 0, F.when(F.col("id") % 7 == 0, "driver").otherwise("passenger")).alias("y"), F.col("id").alias("at"))
    marked = mark_undersample(rows, "y", ["row_id"], seed=3)
    assert marked.count() == 200 and Counter(map(tuple, marked.drop("kept").collect())) == Counter(map(tuple, rows.collect()))
    kept = marked.filter("kept").drop("kept")
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, undersample(rows, "y", ["row_id"], seed=3).collect()))
    assert 0 < kept.count() < 200 and marked.filter("kept is null").count() == 0
