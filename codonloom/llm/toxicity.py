"""Toxicity: a linear classifier over byte n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.llm import ngrams
from codonloom.llm.arrow import map_texts

BITS = 20
MAX_TRAIN_ROWS = 5000
THRESHOLD = 0.7


def held_out() -> F.Column:
    """Rows kept for evaluation: crc32 of the id as text has remainder 1 by three."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(text: bytes) -> np.ndarray:
    """Distinct bins of the lower-cased byte 4- to 7-grams; white space counts as one blank."""
    flat = b" " + b" ".join(text.translate(ngrams.LOWER).split()) + b" "
    return ngrams.distinct_bins(ngrams.char_grams(flat, (4, 5, 6, 7)), BITS)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> ngrams.LinearModel:
    """Fit on at most `max_rows` labelled rows, none of them held out."""
    rows = ngrams.labelled_sample(docs, labels, "toxic", ~held_out(), max_rows)
    return ngrams.fit([features(t) for t, _ in rows], np.array([y for _, y in rows]), BITS, by_ratio=True,
                      features=1 << 12, smooth=0.5)


def score(docs: DataFrame, model: ngrams.LinearModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Probability of being toxic for every row; null and empty texts get the bias alone."""
    return map_texts(docs, lambda texts: [np.array([model.score(features(t)) for t in texts])], "score double", keep)
