"""Search over settings and folds that keeps predictions instead of models.

Every model of a (setting, fold) pair scores the rows it has not seen as soon as it is
trained, and is dropped. The predictions of all pairs are one written table; one aggregate
over it gives the area of every setting on every fold.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.learn.encode import LEVELS
from codonloom.learn.evaluate import auc
from codonloom.learn.models import Recipe
from codonloom.learn.validate import score_expression, without_target
from codonloom.session import scratch_path, stage

TASK_ROWS = 20_000  # rows a task should have at least


def scores_by_setting(recipe: Recipe, model: PipelineModel, data: DataFrame, keep, first: int = 0) -> DataFrame:
    """`keep` columns, `setting` and `score`, a row for each setting that one fitted model covers."""
    fitted = without_target(model)
    if recipe.spread is None:
        return fitted.transform(data).select(*keep, F.lit(first).alias("setting"), score_expression(recipe.score_column).alias("score"))
    spread = PipelineModel([*fitted.stages[:-1], recipe.spread(fitted.stages[-1], recipe.variants)])
    scored = spread.transform(data).select(*keep, F.posexplode("scores").alias("_at", "score"))
    return scored.select(*keep, (F.col("_at") + first).cast("int").alias("setting"), "score")


def fold_predictions(recipe: Recipe, data: DataFrame, row_id: str, label: str, k: int = 10, fold: str = "fold",
                     parallelism: int = 8) -> DataFrame:
    """(setting, fold, row_id, obs, score): every row once per setting, scored by a model that never saw it.

    `data` should be a written table. `parallelism` fits run at a time, fold after fold; each
    writes its predictions and is forgotten. All stages but the last do not depend on the
    setting: they are fitted once per fold, and the rows they prepare are cached until the
    last fit of the fold is done. Settings are numbered by grid entry and, within it, by what
    one fit covers.
    """
    spark = data.sparkSession
    path = scratch_path(spark, f"predictions_{recipe.name}")
    per_fit, fits = max(1, len(recipe.variants)), len(recipe.grid)
    # Every iteration of a fit is a job of its own, so small tables are better read by few tasks.
    tasks = max(1, data.count() // TASK_ROWS)
    *steps, estimator = recipe.pipeline.getStages()
    inputs = [estimator.getOrDefault(estimator.featuresCol), estimator.getOrDefault(estimator.labelCol)]
    # An estimator that fits several settings in one go gets all of them at once.
    tries = [list(range(fits))] if getattr(estimator, "fits_together", False) else [[n] for n in range(fits)]
    locks, left, prepared = [Lock() for _ in range(k)], [len(tries)] * k, [None] * k

    def work(i, numbers):
        with locks[i]:
            if prepared[i] is None:
                train = data.filter(F.col(fold) != i).coalesce(tasks)
                coding = Pipeline(stages=steps).fit(train)
                prepared[i] = coding, coding.transform(train).select(*inputs).persist()
        coding, rows = prepared[i]
        held = data.filter(F.col(fold) == i).coalesce(tasks)
        try:
            for number, fitted in zip(numbers, estimator.fit(rows, [recipe.grid[n] for n in numbers]), strict=True):
                scored = scores_by_setting(recipe, PipelineModel([*coding.stages, fitted]), held, [row_id, label], number * per_fit)
                scored.select("setting", F.lit(i).alias("fold"), F.col(row_id).alias("row_id"), F.col(label).alias("obs"), "score").write.parquet(
                    f"{path}/fit_{number}_{i}")
        finally:
            with locks[i]:
                left[i] -= 1
                done = not left[i]
            if done:
                rows.unpersist()

    with ThreadPoolExecutor(parallelism) as pool:
        # Each task is wrapped by itself: a wrapped function owns one set of the session's thread
        # properties, which threads that share it overwrite for one another.
        started = [pool.submit(inheritable_thread_target(spark)(partial(work, i, n))) for i in range(k) for n in tries]
        for future in started:
            future.result()
    kind = data.schema[row_id].dataType.simpleString()
    seen = data.schema[label].dataType.simpleString()
    return spark.read.schema(f"setting int, fold int, row_id {kind}, obs {seen}, score double").parquet(
        *[f"{path}/fit_{n}_{i}" for n in range(fits) for i in range(k)])


def areas(predictions: DataFrame, positive=LEVELS[1]) -> DataFrame:
    """(setting, fold, auc) of all settings on all folds."""
    return auc(predictions, "obs", "score", positive, ["setting", "fold"])


def mean_areas(by_fold: DataFrame) -> DataFrame:
    """(setting, auc): mean over the folds that hold both classes."""
    return by_fold.groupBy("setting").agg(F.avg("auc").alias("auc"))


def best_of(means: DataFrame) -> int:
    """Setting with the largest mean area, the first of equals."""
    return means.orderBy(F.desc_nulls_last("auc"), "setting").first()["setting"]


@dataclass
class Found:
    """Outcome of a search: all predictions, mean areas, the best setting and its model fitted on all rows."""

    recipe: Recipe
    predictions: DataFrame
    means: DataFrame
    best: int
    model: PipelineModel

    def held_out(self, levels=LEVELS, threshold: float = 0.5) -> DataFrame:
        """(row_id, fold, obs, pred, score) of the best setting, every row once."""
        rows = self.predictions.filter(F.col("setting") == self.best)
        return rows.select("row_id", "fold", "obs", called(threshold if self.recipe.score_column == "probability" else 0.0, levels), "score")

    def score(self, data: DataFrame, keep, levels=LEVELS, threshold: float = 0.5) -> DataFrame:
        """`keep` columns, class and score of the best setting for any table with the predictors."""
        per_fit = max(1, len(self.recipe.variants))
        scored = scores_by_setting(self.recipe, self.model, data, keep).filter(F.col("setting") == self.best % per_fit)
        return scored.select(*keep, called(threshold if self.recipe.score_column == "probability" else 0.0, levels), "score")


def called(threshold: float, levels=LEVELS):
    """Class by a cut of the score."""
    negative, positive = (F.lit(v) for v in levels)
    return F.when(F.col("score") >= threshold, positive).otherwise(negative).alias("pred")


def search(recipe: Recipe, data: DataFrame, row_id: str, label: str, k: int = 10, fold: str = "fold", parallelism: int = 8,
           levels=LEVELS) -> Found:
    """Predictions of every setting on every fold, and the best setting fitted on all rows."""
    recipe = recipe.plan(recipe, data) if recipe.plan else recipe
    predictions = fold_predictions(recipe, data, row_id, label, k, fold, parallelism)
    means = stage(mean_areas(areas(predictions, levels[1])), "areas")
    best = best_of(means)
    model = recipe.pipeline.fit(data.coalesce(max(1, data.count() // TASK_ROWS)), recipe.grid[best // max(1, len(recipe.variants))])
    return Found(recipe, predictions, means, best, model)
