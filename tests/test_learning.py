"""Models on a small separable table."""

import os
import sys

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from codonloom.learn import importance, neighbors, search, validate
from codonloom.learn.encode import feature_stages
from codonloom.learn.evaluate import auc
from codonloom.learn.models import recipes
from codonloom.operators.sampling import assign_folds
from codonloom.sources.schemas import BINARY_FEATURES, NUMERIC_FEATURES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

NUMERIC, BINARY = ("a", "b"), ("flag",)


@pytest.fixture(scope="module")
def data(spark):
    noise = (F.col("id") * 7919 % 97) / 97
    rows = spark.range(240).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "driver").otherwise("passenger").alias("y"),
        (noise + F.when(F.col("id") % 2 == 0, 0.8).otherwise(0.0)).alias("a"),
        ((F.col("id") * 104729 % 89) / 89).alias("b"), (F.col("id") % 5 == 0).cast("int").alias("flag"))
    return assign_folds(rows, "y", ["row_id"], 3).coalesce(2).cache()


@pytest.mark.parametrize("name", ["random_forest", "decision_tree", "boosted_trees", "logistic_regression",
                                  "radial_svm", "multilayer_perceptron"])
def test_models_beat_chance(data, name):
    recipe = recipes(NUMERIC, BINARY, "y")[name]
    recipe.grid = recipe.grid[-1:]
    held_out = search.search(recipe, data, "row_id", "y", 3).held_out().cache()
    assert held_out.count() == 240 and held_out.select("row_id").distinct().count() == 240
    assert auc(held_out, "obs", "score").first().auc > 0.7
    if recipe.score_column == "probability":
        assert held_out.filter(~F.col("score").between(0, 1)).count() == 0


def test_saved_kernel_model_scores_alike(data, tmp_path):
    recipe = recipes(NUMERIC, BINARY, "y")["radial_svm"]
    model = recipe.pipeline.fit(data, recipe.grid[0])
    validate.save(model, str(tmp_path / "m"))
    again = validate.load(str(tmp_path / "m"))
    a = validate.score(model, recipe, data, ["row_id"])
    b = validate.score(again, recipe, data, ["row_id"])
    assert a.exceptAll(b).count() == 0


def test_unlabelled_rows_are_scored(data):
    recipe = recipes(NUMERIC, BINARY, "y")["decision_tree"]
    model = recipe.pipeline.fit(data, recipe.grid[0])
    some = data.withColumn("y", F.when(F.col("row_id") % 6 != 0, F.col("y")))
    got = validate.score(model, recipe, some, ["row_id"])
    assert got.exceptAll(validate.score(model, recipe, data, ["row_id"])).count() == 0 and got.count() == 240
    assert validate.score(model, recipe, data.drop("y"), ["row_id"]).count() == 240


def test_permutation_finds_the_informative_feature(data):
    recipe = recipes(NUMERIC, BINARY, "y")["logistic_regression"]
    model = recipe.pipeline.fit(data, recipe.grid[0])
    rows = importance.permutation_importance(model, data, (*NUMERIC, *BINARY), "row_id", "y", "driver").collect()
    got = {r.feature_name: r.importance for r in rows}
    assert got["a"] > 0.2 and abs(got["b"]) < 0.1
    overall = {r.feature_name: r.overall for r in rows}
    assert overall["a"] == 100.0 and min(overall.values()) == 0.0


def test_impurity_is_scaled_to_100(spark, data):
    recipe = recipes(NUMERIC, BINARY, "y")["decision_tree"]
    model = recipe.pipeline.fit(data, recipe.grid[0])
    got = importance.impurity_importance(spark, model, (*NUMERIC, *BINARY)).orderBy(F.desc("overall")).first()
    assert got.feature_name == "a" and got.overall == pytest.approx(100.0)
    flat = importance.spread_to_100(spark.createDataFrame([("x", 2.0), ("y", 2.0), ("z", 2.0)], "feature_name string, importance double"))
    assert {r.overall for r in flat.collect()} == {0.0}
    some = importance.spread_to_100(spark.createDataFrame([("x", -1.0), ("y", 1.0), ("z", 3.0)], "feature_name string, importance double"))
    assert {r.feature_name: r.overall for r in some.collect()} == {"x": 0.0, "y": 50.0, "z": 100.0}


@pytest.mark.parametrize("coding, width", [("plain", 51), ("treatment", 51), ("full", 73)])
def test_feature_widths(spark, coding, width):
    row = {c: 1.0 for c in NUMERIC_FEATURES} | {c: 0 for c in BINARY_FEATURES}
    df = spark.createDataFrame([row, {k: v * 2 for k, v in row.items()}])
    stages = feature_stages(coding=coding, scale=False)
    assert Pipeline(stages=stages).fit(df).transform(df).first().features.size == width


def test_feature_levels(spark):
    levels = importance.feature_levels(spark)
    assert levels.count() == 51 and levels.filter("feature_category = 'Mutation level'").count() == 4


def test_nearest_on_folds_of_one_table(spark):
    table = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(20)], "row_id bigint, features array<double>, label int")
    folds = table.filter("row_id % 4 <> 0"), table.filter("row_id % 4 = 0")
    found = {(r.row_id, r.neighbor) for r in neighbors.nearest(*folds, 1).collect()}
    assert found == {(0, 1), (4, 3), (8, 7), (12, 11), (16, 15)}
    own = neighbors.nearest(table, table, 1, skip_same_id=True).collect()
    assert len(own) == 20 and all(r.distance == 1.0 for r in own)


def test_a_saved_model_knows_what_it_can_score(spark, data, tmp_path):
    recipe = recipes(NUMERIC, BINARY, "y")["decision_tree"]
    model, path = recipe.pipeline.fit(data, recipe.grid[0]), str(tmp_path / "m")
    validate.save(model, path, validate.Signature(NUMERIC, BINARY))
    again, signature = validate.load(path), validate.load_signature(spark, path)
    assert signature == validate.Signature(NUMERIC, BINARY)
    want = validate.score(model, recipe, data, ["row_id"])
    other = data.select("flag", F.col("b").alias("beta"), "row_id", F.col("a").cast("float").cast("double").alias("a"), F.lit("x").alias("more"))
    fitted = signature.fitted(other, {"beta": "b"})
    assert fitted.schema["flag"].dataType.simpleString() == "int" and fitted.columns[:2] == ["flag", "b"]
    got = validate.score(again, recipe, fitted, ["row_id"])
    assert got.count() == 240 and got.join(want.withColumnRenamed("score", "s"), "row_id").filter("abs(score - s) > 0.2").count() < 24
    for bad, told in ((data.drop("a"), "a is missing"), (data.withColumn("b", F.lit("x")), "b is string"),
                      (data.withColumn("flag", F.col("flag") + 1), "flag holds other values than 0 and 1 in 48 rows")):
        with pytest.raises(ValueError, match=told):
            signature.fitted(bad)


def test_report_with_neighbours_and_a_competitor(data):
    from codonloom.plans.report import train_and_report

    bench = data.withColumn("rival", F.when(F.col("y") == "driver", 0.9).otherwise(0.1)).drop("fold")
    recipe = recipes(NUMERIC, BINARY, "y")["decision_tree"]
    rows = train_and_report(data.drop("fold"), {"bench": bench}, [recipe], "y", "row_id", k=3, neighbors=(*NUMERIC, *BINARY), rivals={"bench": "rival"}).collect()
    got = {(r.dataset, r.classifier, r.measure): r.score for r in rows}
    assert len(got) == len(rows) == 8 * 5
    assert {d for d, c, _ in got if c == "competitor"} == {"bench", "bench_balanced"} and got["bench", "competitor", "auc"] == 1.0
    for name in ("decision_tree", "nearest_neighbors"):
        assert {d for d, c, _ in got if c == name} == {"held_out", "bench", "bench_balanced"}
        assert got["held_out", name, "auc"] > 0.7 and got["bench", name, "accuracy"] > 0.7


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_saved_model_scores_need_no_folds(spark, monkeypatch):
    monkeypatch.setattr(search, "fold_predictions", None)
    monkeypatch.setattr("codonloom.catalog.learning._SEARCHES", {})
    row = contract.queries()["saved_model_scores"](spark, "/root/testdata/sf0.001").first()
    assert row["n"] == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count() and row["n_different"] == 0
