"""Scoring, saving and loading of fitted pipelines."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from codonloom.learn.encode import LEVELS, TARGET
from codonloom.learn.models import Recipe


def score_expression(score_column: str) -> Column:
    """Score of the positive class."""
    return F.get(vector_to_array(score_column), F.lit(1))


def without_target(model: PipelineModel) -> PipelineModel:
    """The stages that scoring needs: all but the one that indexes the label."""
    return PipelineModel([
        s for s in model.stages
        if not (s.hasParam("outputCol") and s.isSet("outputCol") and s.getOrDefault("outputCol") == TARGET)])


def score(model, recipe: Recipe, data: DataFrame, keep, label: str | None = None,
          levels=LEVELS, threshold: float = 0.5) -> DataFrame:
    """Class and score for each row, labelled or not.

    `pred` compares a probability with `threshold`; a margin is cut at zero.
    """
    scored = without_target(model).transform(data).withColumn("score", score_expression(recipe.score_column))
    cut = threshold if recipe.score_column == "probability" else 0.0
    negative, positive = (F.lit(v) for v in levels)
    observed = [F.col(label).alias("obs")] if label else []
    return scored.select(
        *keep, *observed, F.when(F.col("score") >= cut, positive).otherwise(negative).alias("pred"), "score")


@dataclass(frozen=True)
class Signature:
    """What a table must hold to be scored: the predictors by kind, the class names and the column of the score."""

    numeric: tuple[str, ...]
    binary: tuple[str, ...] = ()
    levels: tuple[str, ...] = LEVELS
    score_column: str = "probability"

    def fitted(self, data: DataFrame, renamed: dict[str, str] | None = None, values: bool = True) -> DataFrame:
        """`data` with its predictors under the names and kinds the model knows, or a ValueError that lists what is wrong.

        `renamed` maps columns of the table to predictors. Order and further columns do not
        matter. With `values`, one pass makes sure that 0/1 predictors hold nothing else.
        """
        table = data.withColumnsRenamed(renamed or {})
        kinds = {f.name: f.dataType for f in table.schema.fields}
        wrong = [f"{c} is missing" for c in (*self.numeric, *self.binary) if c not in kinds]
        wrong += [f"{c} is {kinds[c].simpleString()}, not a number" for c in (*self.numeric, *self.binary)
                  if c in kinds and not isinstance(kinds[c], (NumericType, BooleanType))]
        if values and self.binary and not wrong:
            found = table.agg(*[F.count_if(~F.col(c).cast("double").isin(0.0, 1.0)).alias(c) for c in self.binary]).first()
            wrong = [f"{c} holds other values than 0 and 1 in {found[c]} rows" for c in self.binary if found[c]]
        if wrong:
            raise ValueError("the table does not fit the model: " + "; ".join(wrong))
        cast = {c: F.col(c).cast("double") for c in self.numeric} | {c: F.col(c).cast("int") for c in self.binary}
        return table.withColumns(cast)


def save(model: PipelineModel, path: str, signature: Signature | None = None) -> None:
    """Write a fitted pipeline and, next to its stages, what it expects of a table."""
    model.write().overwrite().save(path)
    if signature:
        text = json.dumps(asdict(signature))
        SparkSession.active().createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/signature")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_signature(spark: SparkSession, path: str) -> Signature:
    """The signature saved with a model."""
    held = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/signature").collect()))
    return Signature(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})
