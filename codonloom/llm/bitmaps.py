"""Bitmaps of hashes, to leave out most rows that a join would drop before they are shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 26  # of a bitmap: 8 MB, whatever the size of the corpus


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for the last bits of each hash in the one column; at most 2 ** (FILTER_BITS - 6) rows reach the driver.

    Hashes that are the least of several crowd at the bottom, so leading bits will not do.
    """
    place = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    word = F.shiftright(place, 6).alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint64)


def set_in(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def may_hold(keys: DataFrame, key: str) -> Column:
    """Whether the value of column `key` may be among those in the one column of `keys`, a written table.

    False is certain; a few of the others are true, too, so an exact join has to follow.
    """
    held = keys.sparkSession.sparkContext.broadcast(bitmap(keys.select(F.xxhash64(keys.columns[0]).alias("hash"))))

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(set_in(held.value, hashes.to_numpy()))

    return test(F.xxhash64(key))
