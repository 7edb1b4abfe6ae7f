"""The classifiers, each with its input coding and tuning grid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame

from codonloom.learn.encode import TARGET, feature_stages, label_stage
from codonloom.learn.kernel import CalibratedMargin, Nystroem
from codonloom.learn.logistic import ElasticNet
from codonloom.learn.trees import EnsemblePrefixes, PruningPath, path_settings, read_trees
from codonloom.sources.schemas import BINARY_FEATURES, LABEL, NUMERIC_FEATURES

SEED = 467


@dataclass
class Recipe:
    """A pipeline, its grid, and the column its score is read from.

    Where one fit covers several settings, `spread` makes the fitted last stage score all of
    `variants` at once, into a list `scores`. Where those depend on the data, `plan` gives
    the recipe for a table.
    """

    name: str
    pipeline: Pipeline
    grid: list = field(default_factory=list)
    score_column: str = "probability"
    variants: list = field(default_factory=list)
    spread: Callable | None = None
    plan: Callable | None = None

    def settings(self) -> list[dict]:
        """Names and values of all settings, in the order of their numbers."""
        named = [{p.name: v for p, v in params.items()} for params in self.grid]
        return [{**g, "variant": v} for g in named for v in self.variants] if self.variants else named


def with_pruning_path(recipe: Recipe, data: DataFrame) -> Recipe:
    """Complexities along the pruning path of the tree fitted on all rows."""
    tree = read_trees(recipe.pipeline.fit(data, recipe.grid[0]).stages[-1])[0]
    return replace(recipe, variants=path_settings(tree))


def recipes(numeric=NUMERIC_FEATURES, binary=BINARY_FEATURES, label: str = LABEL,
            levels=("passenger", "driver"), seed: int = SEED) -> dict[str, Recipe]:
    """Every trainable pipeline by name, with ten settings or more each (five for the kernel machine)."""
    target = label_stage(label, levels)
    inputs = len(numeric) + len(binary)
    width = len(numeric) + 2 * len(binary)

    def build(name: str, estimator, coding: str = "plain", grid=None, extra=(), **more):
        stages = [target, *feature_stages(numeric, binary, coding), *extra, estimator]
        return Recipe(name, Pipeline(stages=stages), grid or [{}], **more)

    def on(estimator, **changes):
        grid = ParamGridBuilder()
        for param, values in changes.items():
            grid = grid.addGrid(getattr(estimator, param), values)
        return grid.build()

    forest = RandomForestClassifier(labelCol=TARGET, numTrees=50, maxDepth=8, seed=seed)
    tried = sorted({str(int(round(v))) for v in np.linspace(min(2, inputs), inputs, 4)}, key=int)
    tree = DecisionTreeClassifier(labelCol=TARGET, maxDepth=12, minInstancesPerNode=7, seed=seed)
    boosted = GBTClassifier(labelCol=TARGET, maxIter=20, seed=seed)
    logistic = ElasticNet(labelCol=TARGET)
    machine = CalibratedMargin(labelCol=TARGET)
    perceptron = MultilayerPerceptronClassifier(
        labelCol=TARGET, layers=[width, 5, 2], maxIter=50, seed=seed)
    return {
        r.name: r for r in (
            build("random_forest", forest, grid=on(forest, featureSubsetStrategy=tried),
                  variants=[10, 25, 50], spread=EnsemblePrefixes.of),
            build("decision_tree", tree, spread=lambda m, settings: PruningPath.of(read_trees(m)[0], settings), plan=with_pruning_path),
            build("boosted_trees", boosted, "treatment", on(boosted, maxDepth=[2, 4]),
                  variants=list(range(2, 21, 2)), spread=EnsemblePrefixes.of),
            build("logistic_regression", logistic, "treatment",
                  on(logistic, elasticNetParam=[0.1, 0.325, 0.55, 0.775, 1.0], regParam=[0.001, 0.01])),
            build("radial_svm", machine, "treatment", on(machine, regParam=[1e-4, 1e-3, 1e-2, 1e-1, 1.0]), extra=[Nystroem()]),
            build("multilayer_perceptron", perceptron, "full",
                  on(perceptron, layers=[[width, size, 2] for size in range(1, 20, 2)])),
        )
    }
