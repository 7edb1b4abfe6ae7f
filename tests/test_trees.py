"""Pruning paths and ensemble prefixes from one fit, the kernel machine, and the search over folds."""

import itertools

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from codonloom.learn import kernel, search, trees
from codonloom.learn.models import Recipe, recipes
from codonloom.operators.sampling import assign_folds

NUMERIC, BINARY = ("a", "b"), ("flag",)


@pytest.fixture(scope="module")
def data(spark):
    noise = (F.col("id") * 7919 % 97) / 97
    rows = spark.range(240).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "driver").otherwise("passenger").alias("y"),
        (noise + F.when(F.col("id") % 2 == 0, 0.5).otherwise(0.0)).alias("a"),
        ((F.col("id") * 104729 % 89) / 89).alias("b"), (F.col("id") % 5 == 0).cast("int").alias("flag"))
    return assign_folds(rows, "y", ["row_id"], 3).coalesce(1).cache()


@pytest.fixture(scope="module")
def vectors(data):
    frame = VectorAssembler(inputCols=["a", "b", "flag"], outputCol="features").transform(data)
    # A chequered target with noise, for a tree with many splits.
    square = F.floor(F.col("a") * 2) + F.floor(F.col("b") * 3) + (F.col("row_id") % 11 == 0).cast("int")
    return frame.withColumn("target", (square % 2).cast("double")).cache()


def matrix(frame):
    rows = frame.orderBy("row_id").select(vector_to_array("features").alias("x"), "target").collect()
    return np.array([r.x for r in rows]), np.array([r.target for r in rows])


def prunings(tree, t=0):
    """All subtrees below node t, each as the set of its leaves."""
    yield {t}
    if tree.left[t] >= 0:
        for a, b in itertools.product(prunings(tree, tree.left[t]), prunings(tree, tree.right[t])):
            yield a | b


def test_pruned_trees_are_the_best_of_all_subtrees(vectors):
    model = DecisionTreeClassifier(labelCol="target", maxDepth=4, minInstancesPerNode=5, seed=1).fit(vectors)
    tree = trees.read_trees(model)[0]
    points = trees.collapse_points(tree)
    wrong = tree.counts.sum(1) - tree.counts.max(1)
    everything = list(prunings(tree))
    assert len(everything) > 20
    before = None
    for complexity in [0.0, *np.linspace(0.001, 1.2, 25)]:
        kept, todo = set(), [0]
        while todo:
            t = todo.pop()
            if points[t] <= complexity + 1e-12:
                kept.add(t)
            else:
                todo += [tree.left[t], tree.right[t]]
        cost = {frozenset(s): sum(wrong[t] for t in s) / wrong[0] + complexity * len(s) for s in everything}
        assert cost[frozenset(kept)] <= min(cost.values()) + 1e-9
        assert before is None or len(kept) <= before
        before = len(kept)
    assert before == 1


def test_pruning_path_scores_its_subtrees(vectors):
    model = DecisionTreeClassifier(labelCol="target", maxDepth=5, minInstancesPerNode=5, seed=1).fit(vectors)
    tree = trees.read_trees(model)[0]
    settings = trees.path_settings(tree)
    assert settings[0] == 0.0 and sorted(settings) == settings and 2 < len(settings) <= 10
    scored = trees.PruningPath.of(tree, settings).transform(model.transform(vectors)).orderBy("row_id").collect()
    full = np.array([r.probability[1] for r in scored])
    got = np.array([r.scores for r in scored])
    assert np.allclose(got[:, 0], [tree.counts[n, 1] / tree.counts[n].sum() for n in leaf_after(tree, vectors, 0.0)])
    assert np.abs(got[:, 0] - full).max() < 1e-9 or tree_was_pruned(tree)
    for j, complexity in enumerate(settings):
        assert np.allclose(got[:, j], [tree.counts[n, 1] / tree.counts[n].sum() for n in leaf_after(tree, vectors, complexity)])


def leaf_after(tree, frame, complexity):
    points, (x, _) = trees.collapse_points(tree), matrix(frame)
    found = []
    for row in x:
        t = 0
        while points[t] > complexity + 1e-12:
            t = tree.left[t] if row[tree.feature[t]] <= tree.threshold[t] else tree.right[t]
        found.append(t)
    return found


def tree_was_pruned(tree):
    """Splits that save no error fall at complexity 0 already."""
    return (trees.collapse_points(tree)[tree.left >= 0] == 0).any()


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_prefixes_equal_smaller_ensembles(vectors, kind):
    def fit(n):
        if kind == "boosted":
            return GBTClassifier(labelCol="target", maxIter=n, maxDepth=2, seed=3).fit(vectors)
        return RandomForestClassifier(labelCol="target", numTrees=n, maxDepth=3, seed=3, bootstrap=False, featureSubsetStrategy="all").fit(vectors)

    scored = trees.EnsemblePrefixes.of(fit(6), [1, 3, 6, 9]).transform(vectors).orderBy("row_id").collect()
    got = np.array([r.scores for r in scored])
    for j, n in enumerate((1, 3, 6)):
        want = [r.probability[1] for r in fit(n).transform(vectors).orderBy("row_id").collect()]
        assert np.allclose(got[:, j], want, atol=1e-9)
    assert (got[:, 3] == got[:, 2]).all()  # no more trees than there are


def test_array_scores_are_saved(vectors, tmp_path):
    model = GBTClassifier(labelCol="target", maxIter=3, maxDepth=2, seed=3).fit(vectors)
    part = trees.EnsemblePrefixes.of(model, [2, 3])
    part.save(str(tmp_path / "p"))
    again = trees.EnsemblePrefixes.load(str(tmp_path / "p"))
    assert [r.scores for r in again.transform(vectors).collect()] == [r.scores for r in part.transform(vectors).collect()]


def test_kernel_features_approximate_the_gram_matrix(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5)) + rng.integers(0, 3, 300)[:, None] * 2
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(150)]  # a hot vector
    frame = spark.createDataFrame(rows, "row_id int, x array<double>").select(
        "row_id", array_to_vector("x").alias("features"))
    errors = []
    for size in (30, 150):
        model = kernel.Nystroem(size=size).fit(frame)
        marks = np.array(model.getOrDefault(model.landmarks)).reshape(size, 5)
        assert len(np.unique(marks, axis=0)) == size
        gamma = model.getOrDefault(model.gamma)
        assert gamma == pytest.approx(kernel.width_from(marks))
        z = np.array([r.kernel_features for r in model.transform(frame.filter("row_id < 300")).orderBy("row_id").collect()])
        exact = np.exp(-gamma * kernel.squared_distances(x, x))
        gap = exact - z @ z.T
        assert np.linalg.eigvalsh(gap).min() > -1e-6  # never over the kernel
        errors.append(np.linalg.norm(gap) / np.linalg.norm(exact))
    assert errors[1] < 0.06 and errors[1] < errors[0] / 3
    inside = model.transform(spark.createDataFrame([(v.tolist(),) for v in marks], "x array<double>").select(
        array_to_vector("x").alias("features")))
    zm = np.array([r.kernel_features for r in inside.collect()])
    assert np.abs(zm @ zm.T - np.exp(-gamma * kernel.squared_distances(marks, marks))).max() < 1e-3


def test_kernel_machine_gives_probabilities(data):
    recipe = recipes(NUMERIC, BINARY, "y")["radial_svm"]
    model = recipe.pipeline.fit(data, recipe.grid[2])
    p = [(r.y == "driver", r.probability[1]) for r in model.transform(data).collect()]
    assert all(0 < v < 1 for _, v in p)
    mean = np.mean([v for _, v in p])
    assert abs(mean - 0.5) < 0.1 and np.mean([(v >= 0.5) == y for y, v in p]) > 0.75


def test_search_scores_every_row_once_per_setting(data):
    recipe = recipes(NUMERIC, BINARY, "y")["logistic_regression"]
    few = Recipe(recipe.name, recipe.pipeline, recipe.grid[:2])
    found = search.search(few, data, "row_id", "y", 3)
    rows = found.predictions.collect()
    assert sorted((r.setting, r.row_id) for r in rows) == [(s, i) for s in (0, 1) for i in range(240)]
    folds = {r.row_id: r.fold for r in data.collect()}
    assert all(folds[r.row_id] == r.fold for r in rows)
    # The scores of fold 1 are those of a model fitted without it.
    model = few.pipeline.fit(data.filter("fold <> 1"), few.grid[1])
    want = {r.row_id: r.probability[1] for r in model.transform(data.filter("fold = 1")).collect()}
    assert all(abs(r.score - want[r.row_id]) < 1e-9 for r in rows if r.setting == 1 and r.fold == 1)
    by_hand = {}
    for s in (0, 1):
        areas = []
        for f in range(3):
            good, bad = ([r.score for r in rows if (r.setting, r.fold, r.obs) == (s, f, y)] for y in ("driver", "passenger"))
            areas.append(np.mean([[(a > b) + (a == b) / 2 for b in bad] for a in good]))
        by_hand[s] = np.mean(areas)
    assert {r.setting: pytest.approx(r.auc) for r in found.means.collect()} == by_hand
    assert found.best == max(by_hand, key=by_hand.get) and found.held_out().count() == 240
    assert found.score(data.drop("y"), ["row_id"]).count() == 240


def test_one_fit_covers_the_settings_of_a_path(data):
    recipe = recipes(NUMERIC, BINARY, "y")["decision_tree"]
    found = search.search(recipe, data, "row_id", "y", 3)
    n = len(found.recipe.variants)
    assert n > 1 and found.predictions.count() == n * 240 and len(found.recipe.settings()) == n
    assert 0 <= found.best < n and found.held_out().filter("score between 0 and 1").count() == 240
    scored = found.score(data, ["row_id"])
    assert scored.count() == 240
