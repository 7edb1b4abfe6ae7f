"""Fitted trees as arrays: pruning paths of one tree, and outputs of every prefix of an ensemble.

One fit yields many settings. Pruning a deep tree by its weakest links gives the nested
subtrees of every complexity; adding up the outputs of an ensemble's trees one by one gives
what each smaller ensemble of the same seed would say.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonloom.operators.ordering import running_sums
from codonloom.session import scratch_path, stage

NEVER = float("inf")


@dataclass
class Tree:
    """Nodes by number, parents before children; a leaf has no left child (-1).

    A row goes left when its feature is at most `threshold`. `value` is the node's own
    prediction and `counts` its rows per class (empty for regression trees).
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    counts: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf reached by each row of `x`."""
        at = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(self.left[at] >= 0)
        while len(inner):
            node = at[inner]
            goes_left = x[inner, self.feature[node]] <= self.threshold[node]
            at[inner] = np.where(goes_left, self.left[node], self.right[node])
            inner = inner[self.left[at[inner]] >= 0]
        return at


def _cut(split) -> float:
    """Threshold of a split; a 0/1 feature that Spark splits by category is cut in the middle."""
    values = split["leftCategoriesOrThreshold"]
    if split["numCategories"] == -1:
        return values[0]
    if list(values) == [0.0]:
        return 0.5
    raise ValueError("only numeric and 0/1 features are read")


def read_trees(model) -> list[Tree]:
    """Trees of a fitted classifier, from the tables it saves; they are as small as the model."""
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "treeID" in saved.columns:
        saved = saved.select("treeID", "nodeData.*")
    else:
        saved = saved.withColumn("treeID", F.lit(0))
    held: dict[int, list] = {}
    for r in saved.orderBy("treeID", "id").collect():
        held.setdefault(r["treeID"], []).append(r)
    found = []
    for _, nodes in sorted(held.items()):
        inner = [r["leftChild"] >= 0 for r in nodes]
        found.append(Tree(
            np.array([r["split"]["featureIndex"] if i else 0 for r, i in zip(nodes, inner, strict=True)]),
            np.array([_cut(r["split"]) if i else 0.0 for r, i in zip(nodes, inner, strict=True)]),
            np.array([r["leftChild"] for r in nodes]), np.array([r["rightChild"] for r in nodes]),
            np.array([r["prediction"] for r in nodes]), np.array([list(r["impurityStats"]) for r in nodes])))
    return found


def best_split(data: DataFrame, features, label: str, positive) -> DataFrame:
    """The cut of one numeric column with the least Gini impurity, every midpoint tried.

    Counts per value and running sums over them stand for the rows, so no value is binned
    and no column has to fit one task. Ties go to the first column, then to the lowest cut;
    no row comes back where all columns are constant. Columns: feature (number in
    `features`), threshold, n_left, n_left_positive, n_right, n_right_positive.
    """
    values = F.array(*[F.col(c).cast("double") for c in features])
    long = data.select((F.col(label) == F.lit(positive)).alias("_hit"), F.posexplode(values).alias("feature", "v")).filter("v is not null")
    counts = stage(long.groupBy("feature", "v").agg(F.count("*").alias("n"), F.count_if("_hit").alias("n1")), "value_counts")
    sums = running_sums(counts, "v", {"down": "n", "down1": "n1"}, ["feature"])
    sides = sums.select(
        "feature", "v", F.col("total_down").alias("t"), (F.col("down") - F.col("n")).alias("r"), (F.col("down1") - F.col("n1")).alias("r1"),
        (F.col("total_down") - F.col("down") + F.col("n")).alias("l"), (F.col("total_down1") - F.col("down1") + F.col("n1")).alias("l1")).filter("r > 0")
    impurity = F.expr("(l / t) * 2 * (l1 / l) * (1 - l1 / l) + (r / t) * 2 * (r1 / r) * (1 - r1 / r)")
    best = sides.withColumn("impurity", impurity).orderBy("impurity", "feature", "v").limit(1)
    above = counts.select(F.col("feature").alias("_feature"), F.col("v").alias("_v"))
    return best.join(above, (F.col("feature") == F.col("_feature")) & (F.col("_v") > F.col("v"))).groupBy(
        "feature", "v", "l", "l1", "r", "r1").agg(F.min("_v").alias("next")).select(
        "feature", ((F.col("v") + F.col("next")) / 2).alias("threshold"), F.col("l").alias("n_left"), F.col("l1").alias("n_left_positive"),
        F.col("r").alias("n_right"), F.col("r1").alias("n_right_positive"))


def collapse_points(tree: Tree) -> np.ndarray:
    """For each node the complexity from which on it is a leaf (0 for leaves of the full tree).

    The weakest link is the inner node whose removal adds the least misclassification per
    leaf saved; complexities are shares of the misclassification of the root alone.
    """
    n = len(tree.left)
    wrong = tree.counts.sum(1) - tree.counts.max(1)
    scale = max(wrong[0], 1e-300)
    inner = tree.left >= 0
    points = np.where(inner, NEVER, 0.0)
    level = 0.0
    while inner[0]:
        risk, leaves = wrong.astype(float).copy(), np.ones(n)
        for t in range(n - 1, -1, -1):  # children come after their parents
            if inner[t]:
                risk[t] = risk[tree.left[t]] + risk[tree.right[t]]
                leaves[t] = leaves[tree.left[t]] + leaves[tree.right[t]]
        live = np.zeros(n, np.bool_)
        live[0] = True
        for t in range(n):
            if live[t] and inner[t]:
                live[tree.left[t]] = live[tree.right[t]] = True
        at = np.flatnonzero(inner & live)
        gain = (wrong[at] - risk[at]) / (leaves[at] - 1) / scale
        level = max(level, gain.min())
        weakest = at[gain <= gain.min() + 1e-12]
        points[weakest] = level
        inner[weakest] = False
    return points


def path_settings(tree: Tree, number: int = 10) -> list[float]:
    """At most `number` complexities spread over the pruning path of a tree, the unpruned one first."""
    steps = np.unique(np.append(collapse_points(tree)[tree.left >= 0], 0.0))
    at = np.unique(np.linspace(0, len(steps) - 1, min(number, len(steps))).round().astype(int))
    return [float(steps[i]) for i in at]


class _ArrayScores(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds a list of scores computed from the feature vector in Arrow batches."""

    def _scores(self):
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        work = self._scores()

        @F.pandas_udf("array<double>")
        def scores(batch: pd.Series) -> pd.Series:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
            return pd.Series(list(work(x))) if len(batch) else pd.Series([], dtype=object)

        return dataset.withColumn(self.getOutputCol(), scores(vector_to_array(self.getInputCol())))


class PruningPath(_ArrayScores):
    """Share of the positive class in the leaf of each of several nested prunings of one tree."""

    features = Param(Params._dummy(), "features", "feature of each node", TypeConverters.toListInt)
    thresholds = Param(Params._dummy(), "thresholds", "threshold of each node", TypeConverters.toListFloat)
    left = Param(Params._dummy(), "left", "left child", TypeConverters.toListInt)
    right = Param(Params._dummy(), "right", "right child", TypeConverters.toListInt)
    shares = Param(Params._dummy(), "shares", "share of the positive class", TypeConverters.toListFloat)
    points = Param(Params._dummy(), "points", "complexity from which a node is a leaf", TypeConverters.toListFloat)
    settings = Param(Params._dummy(), "settings", "complexities to score", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="scores", features=None, thresholds=None, left=None, right=None,
                 shares=None, points=None, settings=None):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scores")
        self._set(**self._input_kwargs)

    @staticmethod
    def of(tree: Tree, settings: list[float], **columns: str) -> PruningPath:
        total = np.maximum(tree.counts.sum(1), 1)
        return PruningPath(
            features=tree.feature.tolist(), thresholds=tree.threshold.tolist(), left=tree.left.tolist(), right=tree.right.tolist(),
            shares=(tree.counts[:, 1] / total).tolist(), points=collapse_points(tree).tolist(), settings=list(settings), **columns)

    def _scores(self):
        feature, threshold, left, right, share, point, settings = (
            np.array(self.getOrDefault(p)) for p in (
                self.features, self.thresholds, self.left, self.right, self.shares, self.points, self.settings))

        def work(x: np.ndarray) -> np.ndarray:
            at, out = np.zeros(len(x), np.int64), np.full((len(x), len(settings)), np.nan)
            for _ in range(len(left)):
                stops = np.isnan(out) & (point[at][:, None] <= settings[None] + 1e-12)
                out = np.where(stops, share[at][:, None], out)
                going = np.isnan(out).any(1) & (left[at] >= 0)
                if not going.any():
                    break
                goes_left = x[np.arange(len(x)), feature[at]] <= threshold[at]
                at = np.where(going, np.where(goes_left, left[at], right[at]), at)
            return out

        return work


class EnsemblePrefixes(_ArrayScores):
    """Score of the positive class by each of several leading parts of an ensemble.

    Boosted trees add up weighted outputs and go through a logistic curve; a forest averages
    the class shares of its leaves.
    """

    nodes = Param(Params._dummy(), "nodes", "number of nodes of each tree", TypeConverters.toListInt)
    features = Param(Params._dummy(), "features", "feature of each node", TypeConverters.toListInt)
    thresholds = Param(Params._dummy(), "thresholds", "threshold of each node", TypeConverters.toListFloat)
    left = Param(Params._dummy(), "left", "left child", TypeConverters.toListInt)
    right = Param(Params._dummy(), "right", "right child", TypeConverters.toListInt)
    outputs = Param(Params._dummy(), "outputs", "what a leaf adds", TypeConverters.toListFloat)
    boosted = Param(Params._dummy(), "boosted", "whether the trees are boosted", TypeConverters.toBoolean)
    settings = Param(Params._dummy(), "settings", "tree counts to score", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="scores", nodes=None, features=None, thresholds=None, left=None,
                 right=None, outputs=None, boosted=None, settings=None):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scores")
        self._set(**self._input_kwargs)

    @staticmethod
    def of(model, settings: list[int], **columns: str) -> EnsemblePrefixes:
        trees = read_trees(model)
        boosted = trees[0].counts.shape[1] != 2  # regression trees keep count, sum and sum of squares
        out = [w * t.value if boosted else t.counts[:, 1] / np.maximum(t.counts.sum(1), 1)
               for t, w in zip(trees, model.treeWeights, strict=True)]

        def flat(parts) -> list:
            return np.concatenate(list(parts)).tolist()

        return EnsemblePrefixes(
            nodes=[len(t.left) for t in trees], features=flat(t.feature for t in trees), thresholds=flat(t.threshold for t in trees),
            left=flat(t.left for t in trees), right=flat(t.right for t in trees), outputs=flat(out), boosted=boosted,
            settings=[min(s, len(trees)) for s in settings], **columns)

    def _scores(self):
        sizes = self.getOrDefault(self.nodes)
        feature, threshold, left, right, output = (
            np.split(np.array(self.getOrDefault(p)), np.cumsum(sizes)[:-1]) for p in (
                self.features, self.thresholds, self.left, self.right, self.outputs))
        trees = [Tree(f, t, a, b, o, np.zeros(0)) for f, t, a, b, o in zip(feature, threshold, left, right, output, strict=True)]
        boosted, settings = self.getOrDefault(self.boosted), np.array(self.getOrDefault(self.settings))

        def work(x: np.ndarray) -> np.ndarray:
            total = np.cumsum([t.value[t.leaves(x)] for t in trees], axis=0)[settings - 1].T
            return 1 / (1 + np.exp(-2 * total)) if boosted else total / settings

        return work
