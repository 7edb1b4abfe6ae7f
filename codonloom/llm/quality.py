"""Quality rules: counted rules, then a calibrated n-gram classifier with a fixed threshold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.llm import ngrams
from codonloom.llm.arrow import map_texts

SYMBOLS = b"#*$%&|<>"
BITS = 18
MAX_TRAIN_ROWS = 3000
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8


def repeated_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words inside windows of `width` words (a power of two) that occur at least twice."""
    if len(words) <= width:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    span = 1
    while span < width:  # rank of every window of 2 * span words out of the ranks of its halves
        _, rank = np.unique(rank[:-span] * len(words) + rank[span:], return_inverse=True)
        span *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def rule_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines and repeated words of a text."""
    words = text.split()
    chars = sum(map(len, words))
    inner = np.frombuffer(text, np.uint8)
    chars -= int(((inner & 0xC0) == 0x80).sum())  # continuation bytes are no code points of their own
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def features(text: bytes) -> np.ndarray:
    """Distinct bins of the word 1- and 2-grams and the byte 2- to 4-grams of a text."""
    return ngrams.distinct_bins(
        np.concatenate([ngrams.word_grams(text.split(), (1, 2)), ngrams.char_grams(text, (2, 3, 4))]), BITS)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> ngrams.LinearModel:
    """A logistic regression fitted on at most `max_rows` rows labelled good (1) or bad (0)."""
    rows = ngrams.labelled_sample(docs, labels, "quality", F.lit(True), max_rows)
    return ngrams.fit([features(t) for t, _ in rows], np.array([y for _, y in rows]), BITS, by_ratio=False, features=1 << 14)


def judge(docs: DataFrame, model: ngrams.LinearModel, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, rule outcome, calibrated probability and verdict for every row of `docs`.

    A document fails the rules with under 20 words or with over 30 % of its words in
    repeated windows of eight; the others are kept when the model gives them at least
    `threshold`. Null and empty texts have no words and fail. Columns named in `keep` come
    along; repeated rows are judged one by one.
    """
    def work(texts: list[bytes]) -> list:
        counts = np.array([rule_counts(t) for t in texts], np.int64)
        score = np.array([model.score(features(t)) for t in texts])
        n, repeat = counts[:, 0], counts[:, 4]
        failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
        return [*[np.ascontiguousarray(counts[:, i]) for i in range(5)], failed, ~failed & (score >= threshold), score]

    return map_texts(docs, work, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                     "n_repeat_words bigint, base_failed boolean, kept boolean, quality double", keep)
