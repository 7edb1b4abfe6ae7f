"""Numeric expressions: tolerant casts, row means, the hypergeometric tail."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


MISSING_MARKS = ("-", ".", "NA", "")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """Null in place of NaN and the infinities."""
    x = _col(c)
    bad = F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    return F.when(~bad, x)


def parsed(c) -> Column:
    """Number in a text, null when it is not one; `NaN` and `Infinity` come through.

    The usual marks of a missing score are tested first, because a failed cast costs many
    times a successful one.
    """
    text = F.trim(_col(c))
    return F.when(~text.isin(*MISSING_MARKS), text.try_cast("double"))


def to_number(c) -> Column:
    """Finite number in a text, null when it is not one."""
    return finite(parsed(c))


def row_mean(cols) -> Column:
    """Mean over the present values of a row, null when all are missing."""
    cols = [_col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    present = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    return F.when(present > 0, total / present)


def indicator(condition: Column) -> Column:
    """1 when the condition holds, 0 when it does not, null when it is unknown."""
    return condition.cast("int")


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """ln(n!): exact up to 20, Stirling's series above."""
    exact = np.log(np.array([float(math.factorial(i)) for i in range(21)]))
    x = np.maximum(n, 20.0)
    series = (
        x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x)
        + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    )
    return np.where(n <= 20, exact[np.clip(n, 0, 20).astype(int)], series)


def upper_tail(k: np.ndarray, n: np.ndarray, m: np.ndarray, universe: np.ndarray) -> np.ndarray:
    """P(X >= k) for `n` draws without replacement from `universe` with `m` marked.

    The sum runs away from the mode, so one logarithm-based term starts it and each next
    term is a ratio of the last: above the mode it adds P(k), P(k+1), ...; at or below it
    the complement P(k-1), P(k-2), ... is summed instead. A row stops when its next term
    no longer changes its sum.
    """
    rest = universe - m - n
    low, high = np.maximum(0.0, -rest), np.minimum(n, m)
    above = k > np.floor((n + 1) * (m + 1) / (universe + 2))
    i = np.clip(np.where(above, k, k - 1), low, high)
    lf = _log_factorial
    term = np.exp(
        lf(m) - lf(i) - lf(m - i) + lf(universe - m) - lf(n - i) - lf(rest + i)
        - lf(universe) + lf(n) + lf(universe - n)
    )
    total = term.copy()
    while True:
        more = np.where(above, i < high, i > low) & (total + term != total)
        if not more.any():
            break
        up = (m - i) * (n - i) / ((i + 1) * (rest + i + 1))
        down = i * (rest + i) / np.maximum((m - i + 1) * (n - i + 1), 1.0)
        term = np.where(more, term * np.where(above, up, down), 0.0)
        total = total + term
        i = i + np.where(above, 1.0, -1.0)
    tail = np.where(above, total, 1.0 - total)
    return np.clip(np.where(k <= low, 1.0, np.where(k > high, 0.0, tail)), 0.0, 1.0)


def hypergeometric_tail(k, n, m, universe) -> Column:
    """`upper_tail` over columns of counts.

    Arrow batches: the tail is a loop over whole vectors here, which is far faster than
    stepping a higher-order function through every row.
    """
    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series, m: pd.Series, universe: pd.Series) -> pd.Series:
        arrays = [x.to_numpy(dtype=float) for x in (k, n, m, universe)]
        with np.errstate(divide="ignore", invalid="ignore"):
            return pd.Series(upper_tail(*arrays))

    return tail(_col(k), _col(n), _col(m), _col(universe))
