"""Train on one table, score others, and report."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.learn import neighbor_index
from codonloom.learn.evaluate import comparison
from codonloom.learn.models import Recipe
from codonloom.learn.neighbor_index import NEIGHBORS
from codonloom.learn.neighbors import neighbor_scores
from codonloom.learn.search import areas, best_of, called, mean_areas, search
from codonloom.operators.sampling import assign_folds, mark_undersample, undersample
from codonloom.session import scratch_path, side_by_side, stage

MODELS_AT_ONCE = 3


def balanced(df: DataFrame, label: str, id_columns, levels, k: int, seed: int) -> DataFrame:
    """Undersampled rows with their folds, written once because training reads them often."""
    rows = undersample(df, label, id_columns, levels, seed)
    return stage(assign_folds(rows, label, id_columns, k, seed), "balanced")


def neighbor_results(data: DataFrame, frames: list[tuple[str, DataFrame]], columns, label: str, row_id: str, levels, k: int) -> list:
    """Held-out and test results of nearest neighbours, with the k whose mean area over the folds is largest.

    Test tables carry the flag `kept` of their undersampled rows.
    """
    negative, positive = levels

    def arrays(df: DataFrame) -> DataFrame:
        return df.select(row_id, label, *(c for c in ("fold", "kept") if c in df.columns), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))

    marked = stage(arrays(data), "neighbor_rows")
    folds = stage(neighbor_index.fold_predictions(marked, row_id=row_id, label=label, k=k, positive=positive), "neighbor_folds")
    best = best_of(mean_areas(areas(folds, positive)))
    index = neighbor_index.fit(
        marked.withColumn("_hit", (F.col(label) == positive).cast("int")), scratch_path(data.sparkSession, "neighbors"), row_id=row_id, label="_hit")
    results = [("held_out", folds.filter(F.col("setting") == best).select("obs", called(0.5, levels), "score"))]
    for name, table in frames:
        rows = arrays(table)
        found = neighbor_scores(neighbor_index.search(index, rows, NEIGHBORS[best], row_id=row_id), NEIGHBORS[best])
        seen = rows.select(F.col(row_id).cast("long").alias("row_id"), F.col(label).alias("obs"), "kept")
        results.append((name, found.join(seen, "row_id").select("obs", called(0.5, levels), "score", "kept")))
    return results


def train_and_report(train: DataFrame, tests: dict[str, DataFrame], recipes: list[Recipe], label: str,
                     row_id: str, levels=("passenger", "driver"), k: int = 10, seed: int = 467, neighbors=(),
                     rivals: dict[str, str] | None = None) -> DataFrame:
    """Measures of every model on held-out folds and on every test table.

    Test tables are reported twice: with their natural class sizes and undersampled.
    `neighbors` lists the columns for nearest neighbours, which take part if it is not empty;
    `rivals` names, by table, a column with the score of another predictor, reported as
    ``competitor`` on the same rows. Columns: dataset, classifier, measure, score.
    """
    data = balanced(train, label, [row_id], levels, k, seed)
    # Undersampled rows are some of the rows of a table: flagged, every row is scored once for both reports.
    frames = [(name, stage(mark_undersample(table, label, [row_id], levels, seed), name)) for name, table in tests.items()]

    def written(classifier: str, results) -> DataFrame:
        """Predictions of one model for all reports, each row scored once."""
        parts = []
        for name, r in results:
            names = F.array(F.lit(name), F.when(F.col("kept"), F.lit(f"{name}_balanced"))) if "kept" in r.columns else F.array(F.lit(name))
            parts.append(r.select(F.explode(F.array_compact(names)).alias("dataset"), F.lit(classifier).alias("classifier"), "obs", "pred", "score"))
        return stage(reduce(lambda a, b: a.unionByName(b), parts), classifier)

    def trained(recipe: Recipe) -> DataFrame:
        found = search(recipe, data, row_id, label, k, levels=levels)
        return written(recipe.name, [("held_out", found.held_out(levels))] + [
            (name, found.score(table, [row_id, label, "kept"], levels).withColumnRenamed(label, "obs")) for name, table in frames])

    # Searches have many small jobs and work of their own on the driver: a few at a time keep the executors busy.
    builds = [partial(trained, r) for r in recipes]
    if neighbors:
        builds.append(lambda: written("nearest_neighbors", neighbor_results(data, frames, neighbors, label, row_id, levels, k)))
    if known := [(name, table, rivals[name]) for name, table in frames if name in (rivals or {})]:
        builds.append(lambda: written("competitor", [
            (name, table.select(F.col(label).alias("obs"), F.col(column).alias("score"), "kept").select("obs", called(0.5, levels), "score", "kept"))
            for name, table, column in known]))
    stacked = reduce(lambda a, b: a.unionByName(b), side_by_side(data.sparkSession, *builds, most=MODELS_AT_ONCE))
    # One evaluation over all models and tables: the pair is the classifier key.
    keyed = stacked.withColumn("run", F.concat_ws("/", "dataset", "classifier"))
    table = comparison(keyed, "obs", "pred", "score", levels[1], "run")
    return table.select(
        F.substring_index("run", "/", 1).alias("dataset"), F.substring_index("run", "/", -1).alias("classifier"),
        "measure", "score")
