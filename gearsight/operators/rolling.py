"""Row-based rolling features per device.

pandas semantics kept: ``rolling(w, min_periods=1)`` mean/min/max skip
nulls, ``std`` is the sample std with a single observation giving 0;
``diff`` fills 0; ``pct_change`` forward-fills first, then divides, with
+-infinity on a zero base and 0 for 0/0 and leading rows.

All rolling frames of one call share one window partitioning (key +
block) and one sort, so many features cost one shuffle. Means and standard
deviations are one vectorised pass over these rows (``wide_rolling``), with the
figures of Spark's own frames to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from gearsight.operators.ordered import DEFAULT_BLOCK_ROWS, ordered_window
from gearsight.operators.wide_rolling import rolling_mean_std


def _rolling_cols(w: WindowSpec, cols: list[str], windows: list[int], stats: tuple[str, ...]
                  ) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for c in cols:
        for n in windows:
            fr = w.rowsBetween(-(n - 1), 0)
            if "min" in stats:
                out[f"{c}_min_{n}"] = F.min(c).over(fr)
            if "max" in stats:
                out[f"{c}_max_{n}"] = F.max(c).over(fr)
    return out


def pct_change_expr(cur_filled: Column, prev_filled: Column) -> Column:
    """pandas pct_change on forward-filled values, then fillna(0)."""
    inf = F.lit(float("inf"))
    return (F.when(cur_filled.isNull() | prev_filled.isNull(), F.lit(0.0))
            .when(prev_filled == 0,
                  F.when(cur_filled == 0, F.lit(0.0)).when(cur_filled > 0, inf).otherwise(-inf))
            .otherwise(cur_filled / prev_filled - 1.0))


def rolling_features(df: DataFrame, key: list[str], order: list[str], cols: list[str],
                     windows: list[int] = (5, 15, 30),
                     stats: tuple[str, ...] = ("mean", "std", "min", "max"),
                     with_diff: bool = True, with_pct: bool = True,
                     block_rows: int = DEFAULT_BLOCK_ROWS, write_once: bool = False) -> DataFrame:
    """W1 + W2 per key, ordered by ``order`` (unique within a key)."""
    windows = list(windows)

    def build(w: WindowSpec) -> dict[str, Column]:
        out = _rolling_cols(w, cols, windows, stats)
        if with_diff:
            for c in cols:
                out[f"{c}_diff"] = F.coalesce(F.col(c) - F.lag(c, 1).over(w), F.lit(0.0))
        if with_pct:
            for c in cols:
                out[f"{c}_pct_change"] = pct_change_expr(F.col(f"{c}__ff"),
                                                         F.lag(f"{c}__ff", 1).over(w))
        return out

    def moments(rows: DataFrame, key: list[str], order: list[str], placed: bool) -> DataFrame:
        return rolling_mean_std(rows, key, order, cols, windows, placed, as_window=True)

    out = ordered_window(df, key, order, build, lookback=max(windows + [2]) - 1,
                         ffill=cols if with_pct else None, block_rows=block_rows, write_once=write_once,
                         rows_pass=moments if {"mean", "std"} & set(stats) else None)
    wanted = {"mean": "ma", "std": "std", "min": "min", "max": "max"}
    made = [f"{c}_{wanted[x]}_{n}" for c in cols for n in windows for x in wanted if x in stats]
    made += [f"{c}_{x}" for x, on in (("diff", with_diff), ("pct_change", with_pct)) if on for c in cols]
    return out.select(*df.columns, *made)


def abs_step(df: DataFrame, key: list[str], order: list[str], cols: dict[str, str],
             block_rows: int = DEFAULT_BLOCK_ROWS, write_once: bool = False) -> DataFrame:
    """|c - previous c| per key; first row null. ``cols`` maps input -> output name."""
    out = ordered_window(df, key, order, lambda w: {o: F.abs(F.col(c) - F.lag(c, 1).over(w))
                                                    for c, o in cols.items()},
                         lookback=1, block_rows=block_rows, write_once=write_once)
    return out.drop("_pos")


def ffill_then_zero(df: DataFrame, key: list[str], order: list[str], cols: list[str],
                    block_rows: int = DEFAULT_BLOCK_ROWS, write_once: bool = False) -> DataFrame:
    """Forward fill per key, leading nulls become 0."""
    f = ordered_window(df, key, order, lambda w: {}, lookback=0, ffill=cols, block_rows=block_rows, write_once=write_once)
    return (f.withColumns({c: F.coalesce(F.col(f"{c}__ff"), F.lit(0.0)) for c in cols})
             .drop("_pos", *[f"{c}__ff" for c in cols]))
