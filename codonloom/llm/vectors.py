"""Rows with a usable vector, shared by the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 2.0**16  # components from here up would overflow the exact sums of squares


def _usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < LARGEST))
    return vector.isNotNull() & (F.size(vector) > 0) & whole


def usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector has only finite components, and the length of the vectors.

    Null and empty vectors, those with null or non-finite components and those with a
    component of 65,536 or more in size are left out. Of several lengths the one most rows
    have counts (of those as frequent, the shortest), the other rows are left out as well.
    The length is 0 where no row is left.
    """
    good = rows.filter(_usable(F.col(vector)))
    lengths = good.groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), "length").first()
    length = top["length"] if top else 0
    return good.filter(F.size(vector) == length), length
