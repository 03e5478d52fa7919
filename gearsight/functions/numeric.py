"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column | str, decimals: int = 6) -> Column:
    """Round the binary value: scale by 10^d in double, round, scale back.

    Spark's ``round`` rounds the shortest decimal text of a double half-up,
    so a binary 4.72499... printed as 4.725 becomes 4.73; pandas and DuckDB
    stay on the binary side (4.72). Scaling first keeps that side (Q4).
    """
    c = F.col(c) if isinstance(c, str) else c
    if decimals == 0:
        return F.round(c, 0)
    f = float(10 ** decimals)
    return F.round(c * f, 0) / f


def round_half_even_sql(x: str, decimals: int) -> str:
    """SQL text rounding the *exact* binary value of double ``x`` to
    ``decimals`` places, ties to even: Python's ``round`` and pandas'
    ``Series.round``. The product x * 10^d is split into its rounded value
    p and exact error e (Dekker's two-product, plain double arithmetic),
    so a tie in p is resolved by the sign of e. Valid for 0 <= decimals <= 11.
    The same text runs in Spark SQL and DuckDB.
    """
    s = f"{float(10 ** decimals)!r}"
    a = f"abs({x})"
    c = f"(134217729.0 * {a})"
    xh = f"({c} - ({c} - {a}))"
    xl = f"({a} - {xh})"
    p = f"({a} * {s})"
    e = f"((({xh} * {s}) - {p}) + ({xl} * {s}))"
    f = f"floor({p})"
    frac = f"({p} - {f})"
    up = f"({f} + 1)"
    tie = (f"CASE WHEN {e} > 0 THEN {up} WHEN {e} < 0 THEN {f} "
           f"WHEN {f} % 2 = 0 THEN {f} ELSE {up} END")
    mag = f"(CASE WHEN {frac} > 0.5 THEN {up} WHEN {frac} < 0.5 THEN {f} ELSE {tie} END)"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE sign({x}) * cast({mag} AS DOUBLE) / {s} END)"


def round_half_even(col: str, decimals: int) -> Column:
    """Column form of :func:`round_half_even_sql` over a column name."""
    return F.expr(round_half_even_sql(f"`{col}`", decimals))
