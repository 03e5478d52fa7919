"""Row-wise statistics across a list of columns.

Null rules follow pandas row reductions: ``mean``/``max``/``std`` skip
nulls (std needs two values), ``sum`` of nothing is 0, and the RMS treats
a null as 0 while dividing by the column count.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cols(cols):
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def row_count(cols) -> Column:
    return reduce(add, [F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for c in _cols(cols)])


def row_sum(cols) -> Column:
    return reduce(add, [F.coalesce(c, F.lit(0.0)) for c in _cols(cols)])


def row_abs_sum(cols) -> Column:
    return reduce(add, [F.coalesce(F.abs(c), F.lit(0.0)) for c in _cols(cols)])


def row_mean(cols) -> Column:
    n = row_count(cols)
    return F.when(n > 0, row_sum(cols) / n)


def row_max(cols) -> Column:
    cs = _cols(cols)
    return cs[0] if len(cs) == 1 else F.greatest(*cs)


def row_std(cols) -> Column:
    """Sample standard deviation of the non-null values; null below two values."""
    cs = _cols(cols)
    n = row_count(cs)
    mean = row_sum(cs) / n
    ss = reduce(add, [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cs])
    return F.when(n >= 2, F.sqrt(ss / (n - 1)))


def row_rms_null_zero(cols) -> Column:
    """F8 total error: sqrt(sum(coalesce(c, 0)^2) / number of columns)."""
    cs = _cols(cols)
    return F.sqrt(reduce(add, [F.pow(F.coalesce(c, F.lit(0.0)), 2) for c in cs]) / len(cs))


def vector_norm_null_zero(cols) -> Column:
    """sqrt(x^2 + y^2 + z^2), null as 0."""
    return F.sqrt(reduce(add, [F.pow(F.coalesce(c, F.lit(0.0)), 2) for c in _cols(cols)]))
