"""Lists to rows, rows to indicator columns, wide to long."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_list(c, sep: str = ",") -> Column:
    """Trimmed, non-empty members of a delimited text."""
    text = F.col(c) if isinstance(c, str) else c
    parts = F.transform(F.split(text, r"\Q" + sep + r"\E"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def list_to_rows(df: DataFrame, column: str, value: str, sep: str = ",") -> DataFrame:
    """One row per list member; rows without members disappear."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(split_list(column, sep)).alias(value))


def wide_to_long(df: DataFrame, ids, columns, variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), variable, value)


def present_members(*columns: str) -> Column:
    """The present values of a row as an array."""
    return F.array_compact(F.array(*columns))


def discovered(df: DataFrame, category, limit: int = 1000, missing_name: str = "na") -> tuple[dict[str, str], str | None]:
    """Names for all categories that occur, in order, and one for the missing category where it occurs.

    One distinct pass that brings at most `limit` + 1 values to the driver; more categories
    than `limit` are an error. Column names are the values in lower case with everything but
    letters and digits replaced, numbered where two would be the same.
    """
    value = F.col(category) if isinstance(category, str) else category
    found = [r["v"] for r in df.select(value.cast("string").alias("v")).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"over {limit} categories")
    names: dict[str, str] = {}
    taken = {missing_name} if None in found else set()
    for v in sorted(v for v in found if v is not None):
        plain = re.sub(r"[^0-9a-z]+", "_", v.lower()).strip("_") or "blank"
        name, n = plain, 1
        while name in taken:
            n += 1
            name = f"{plain}_{n}"
        names[v] = name
        taken.add(name)
    return names, missing_name if None in found else None


def category_counts(df: DataFrame, key: str, category, names: dict[str, str],
                    missing_name: str | None = None) -> DataFrame:
    """Rows per key and category as one column per listed category, 0 where there are none.

    `names` maps category values to column names. The value list is explicit, so the
    schema does not depend on the data and one hash aggregate does the pivot.
    """
    value = F.col(category) if isinstance(category, str) else category
    cells = [F.count(F.when(value == v, 1)).alias(n) for v, n in names.items()]
    if missing_name:
        cells.append(F.count(F.when(value.isNull(), 1)).alias(missing_name))
    return df.groupBy(key).agg(*cells)


def category_flags(df: DataFrame, key: str, category, names: dict[str, str],
                   missing_name: str | None = None) -> DataFrame:
    """Like `category_counts` on distinct (key, category) rows: every cell is 0 or 1."""
    value = F.col(category) if isinstance(category, str) else category
    cells = [F.coalesce(F.max(F.when(value == v, 1)), F.lit(0)).alias(n) for v, n in names.items()]
    if missing_name:
        cells.append(F.coalesce(F.max(F.when(value.isNull(), 1)), F.lit(0)).alias(missing_name))
    return df.groupBy(key).agg(*cells)


def composite(*columns: str) -> Column:
    """One category out of several columns."""
    return F.concat_ws("_", *columns)


def list_to_flags(df: DataFrame, key: str, column: str, table: DataFrame, code: str,
                  category, names: dict[str, str], sep: str = ",") -> DataFrame:
    """Indicator columns from a delimited list whose codes a lookup table translates.

    A key keeps its row as soon as one of its codes is in the table.
    """
    codes = list_to_rows(df.select(key, column), column, "_code", sep)
    described = codes.join(table, F.col("_code") == F.col(code))
    return category_flags(described, key, category, names)
