"""Stages that turn a feature table into model input."""

from __future__ import annotations

from pyspark.ml.feature import (
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame

from codonloom.sources.schemas import BINARY_FEATURES, LABEL, NUMERIC_FEATURES

TARGET = "target"
# Index order of the classes: the second one is the positive class.
LEVELS = ("passenger", "driver")


def fixed_levels(spark_columns: dict[str, list[str]]) -> StringIndexerModel:
    """Index columns by the given level order, without a pass over the data."""
    inputs = list(spark_columns)
    model = StringIndexerModel.from_arrays_of_labels(
        [spark_columns[c] for c in inputs], inputCols=inputs, outputCols=[f"{c}_index" for c in inputs])
    return model.setHandleInvalid("error")


def label_stage(label: str = LABEL, levels=LEVELS) -> StringIndexerModel:
    """Numeric target with a fixed class order; works on 0/1 labels too.

    Fitting leaves out rows without a known label; scoring does without this stage.
    """
    return StringIndexerModel.from_labels(
        [str(v) for v in levels], inputCol=label, outputCol=TARGET, handleInvalid="skip")


def alphabetical_levels(columns) -> StringIndexer:
    """Index by the levels found in the data, in alphabetical order."""
    return StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}_index" for c in columns],
        stringOrderType="alphabetAsc", handleInvalid="keep")


def feature_stages(numeric=NUMERIC_FEATURES, binary=BINARY_FEATURES, coding: str = "plain",
                   scale: bool = True) -> list:
    """Assemble (and scale by standard deviation) the predictors into `features`.

    `coding` of the 0/1 columns: ``plain`` keeps one number each, ``treatment`` one dummy
    (k-1 of k levels), ``full`` one column per level.
    """
    numeric, binary = list(numeric), list(binary)
    stages: list = []
    inputs = numeric + binary
    if binary and coding != "plain":
        coded = [f"{c}_levels" for c in binary]
        stages.append(fixed_levels({c: ["0", "1"] for c in binary}))
        stages.append(OneHotEncoder(
            inputCols=[f"{c}_index" for c in binary], outputCols=coded, dropLast=coding == "treatment"))
        inputs = numeric + coded
    assembled = "assembled" if scale else "features"
    stages.append(VectorAssembler(inputCols=inputs, outputCol=assembled, handleInvalid="error"))
    if scale:
        stages.append(StandardScaler(
            inputCol=assembled, outputCol="features", withMean=False, withStd=True))
    return stages


def complete(df: DataFrame, columns) -> DataFrame:
    return df.dropna("any", subset=list(columns))
