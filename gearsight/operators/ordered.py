"""Ordered per-device computations that stay parallel when one device is hot.

A plain ``Window.partitionBy(device)`` sends every row of a device to one
task. With one device holding a third of all rows that task is the job.
Here rows get an exact per-device position first, then the series is cut
into fixed-size blocks of positions; each block is its own window partition
and carries copies of the few neighbour rows its frames need (the halo).

positions:  per key, quantiles of the leading order column cut the rows into
            slices of like size; (key, slice) counts -> running offsets over
            the small count table -> row_number inside (key, slice) + offset.
            Rows without an order value are a slice of their own (the first).
blocks:     block = pos // block_rows; a row also goes to the next block
            when it lies in the last ``lookback`` positions (and to the
            previous block for ``lookahead``); copies are dropped after.
carry:      unbounded "last non-null" (forward fill) is done per block and
            the carry-in comes from a window over the per-block summary.

Every step is an aggregate, an equi-join or a window over bounded
partitions; nothing is collected, and by default no job runs while the plan
is built.

:func:`ordered_window` splits by key: keys of more than ``block_rows`` rows take
the blocked path, all others a plain window (one shuffle). Both give the same
rows. As one lazy plan, each branch reads its input for itself, and where no key
is that large, the adaptive planner finds the large-key table empty and drops the
blocked branch. With ``write_once`` the rows per key are counted first (one job
over the key columns): without a large key the plan is the plain window alone, one
scan and one shuffle; else rows and positions are written once and read back.

Keys are compared as one struct, so null keys match each other everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gearsight.session import written

DEFAULT_BLOCK_ROWS = 1 << 20
SLICES = 128        # quantile slices that one key's rows are numbered in
_KEY = "_key"


def _ordinal(df: DataFrame, column: str) -> Column:
    """A number that rises with an order column; null where it is null."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(column))
    if isinstance(kind, T.NumericType):
        return F.col(column)
    return F.when(F.col(column).isNotNull(), F.lit(0))


def quantile_slices(df: DataFrame, key: list[str], order_col: str) -> DataFrame:
    """``df`` with ``_slice``: non-decreasing in ``order_col`` within a key, -1 for
    null; each slice holds about 1/``SLICES`` of the key's rows (equal values
    are never parted). The quantiles come from a mergeable sketch."""
    d = df.withColumn("_ord", _ordinal(df, order_col))
    cuts = [i / SLICES for i in range(1, SLICES)]
    bounds = d.groupBy(*key).agg(F.array_distinct(F.percentile_approx("_ord", cuts, 10_000)).alias("_bounds"))
    inside = F.size(F.filter("_bounds", lambda b: b < F.col("_ord")))
    return (d.join(bounds, key, "inner")
             .withColumn("_slice", F.when(F.col("_ord").isNull(), F.lit(-1)).otherwise(inside))
             .drop("_ord", "_bounds"))


def with_positions(df: DataFrame, key: list[str], order: list[str],
                   slice_expr: Column | None = None, pos_col: str = "_pos") -> DataFrame:
    """Add ``pos_col``: 0-based rank of each row within its key by ``order``.

    ``order`` must be unique within a key (add a tiebreak id). ``slice_expr``
    replaces the quantile slices; it must be non-null and non-decreasing in
    ``order``. Key columns must not be null (pass a struct of them).
    """
    d = df.withColumn("_slice", slice_expr) if slice_expr is not None else quantile_slices(df, key, order[0])
    counts = d.groupBy(*key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*key, "_slice", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    joined = d.join(offs, [*key, "_slice"], "inner")
    w2 = Window.partitionBy(*key, "_slice").orderBy(*order)
    return (joined.withColumn(pos_col, F.col("_off") + F.row_number().over(w2) - 1)
                  .drop("_off", "_slice"))


def halo_blocks(df: DataFrame, lookback: int, block_rows: int, pos_col: str = "_pos") -> DataFrame:
    """``df`` with ``_blk``, the block of each row's position, and once more, as
    ``_halo``, the last ``lookback`` rows of a block in front of the next one."""
    if block_rows < lookback:
        raise ValueError("block_rows must reach as far back as the frames")
    pos = F.col(pos_col)
    blk = F.floor(pos / F.lit(block_rows))
    copies = F.array(F.lit(0), F.when(pos - blk * block_rows >= block_rows - lookback, F.lit(1)))
    return (df.withColumn("_shift", F.explode(F.filter(copies, lambda x: x.isNotNull())))
            .withColumns({"_blk": blk + F.col("_shift"), "_halo": F.col("_shift") == 1}).drop("_shift"))


def blocked_window(df: DataFrame, key: list[str], build: Callable[[WindowSpec], dict[str, Column]],
                   lookback: int, lookahead: int = 0, block_rows: int = DEFAULT_BLOCK_ROWS,
                   pos_col: str = "_pos",
                   rows_pass: Callable[[DataFrame, list[str], list[str], bool], DataFrame] | None = None) -> DataFrame:
    """Evaluate window columns whose frames reach at most ``lookback`` rows
    back and ``lookahead`` rows forward, over a frame that has positions.

    ``build(w)`` receives the window (partition = key + block, order = pos)
    and returns {name: column}; frames are added by the caller
    (``w.rowsBetween(-(n - 1), 0)``) and must stay within the reach given.
    ``rows_pass``: see :func:`ordered_window`.
    """
    if block_rows <= max(lookback, lookahead):
        raise ValueError("block_rows must exceed the frame reach")
    pos = F.col(pos_col)
    blk = F.floor(pos / F.lit(block_rows))
    off = pos - blk * block_rows
    shifts = F.array(
        F.lit(0),
        F.when(off >= block_rows - lookback, F.lit(1)),
        F.when(off < lookahead, F.lit(-1)),
    )
    rows = (df.withColumn("_blk0", blk)
              .withColumn("_shift", F.explode(F.filter(shifts, lambda x: x.isNotNull())))
              .withColumn("_blk", F.col("_blk0") + F.col("_shift")))
    w = Window.partitionBy(*key, "_blk").orderBy(pos)
    columns = build(w)
    out = rows.withColumns(columns)
    if rows_pass:
        out = rows_pass(out, [*key, "_blk"], [pos_col], bool(columns))
    return out.where(F.col("_shift") == 0).drop("_blk0", "_shift", "_blk")


def forward_fill(df: DataFrame, key: list[str], cols: list[str], block_rows: int = DEFAULT_BLOCK_ROWS,
                 pos_col: str = "_pos", suffix: str = "") -> DataFrame:
    """Last non-null value at or before each row, per key (unbounded reach),
    computed per block with a carry-in from earlier blocks."""
    pos = F.col(pos_col)
    d = df.withColumn("_blk", F.floor(pos / F.lit(block_rows)))
    summ = d.groupBy(*key, "_blk").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), pos)).alias(f"_last_{i}")
          for i, c in enumerate(cols)])
    wb = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*key, "_blk", *[F.last(f"_last_{i}", ignorenulls=True).over(wb).alias(f"_carry_{i}")
                                       for i in range(len(cols))])
    d = d.join(carry, [*key, "_blk"], "left")
    w = Window.partitionBy(*key, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    filled = {f"{c}{suffix}": F.coalesce(F.last(F.col(c), ignorenulls=True).over(w), F.col(f"_carry_{i}"))
              for i, c in enumerate(cols)}
    return d.withColumns(filled).drop("_blk", *[f"_carry_{i}" for i in range(len(cols))])


def ordered_window(df: DataFrame, key: list[str], order: list[str],
                   build: Callable[[WindowSpec], dict[str, Column]], lookback: int, lookahead: int = 0,
                   ffill: list[str] | None = None, block_rows: int = DEFAULT_BLOCK_ROWS,
                   write_once: bool = False,
                   rows_pass: Callable[[DataFrame, list[str], list[str], bool], DataFrame] | None = None) -> DataFrame:
    """Window columns over rows ordered by ``order`` within ``key``.

    ``build(w)`` gets a window ordered within the key (by ``order``, or by the
    per-key position ``_pos``, which is also a column) and returns
    {name: column}; frames must stay within
    ``lookback`` rows back and ``lookahead`` rows ahead. ``ffill`` columns get
    a forward-filled twin ``<c>__ff`` (unbounded reach) before ``build``.
    ``rows_pass(df, key, order, placed)`` adds columns in one pass over the rows
    of a key or block in order, with the same reach back; ``placed``: rows of
    equal key share a partition already.
    Every input row comes out once, also with null keys or order values
    (nulls order first), whatever ``block_rows`` is.
    """
    ffill = ffill or []
    df = df.withColumn(_KEY, F.struct(*key))
    large = (df.groupBy(_KEY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows).select(_KEY))
    keep = written if write_once else (lambda frame: frame)
    if write_once:
        large = written(large)
    any_large = not (write_once and large.isEmpty())
    df = keep(df) if any_large else df

    def plain(part: DataFrame) -> DataFrame:
        # one spec for the position and the features: one shuffle, one sort
        w = Window.partitionBy(_KEY).orderBy(*order)
        p = part.withColumn("_pos", F.row_number().over(w) - 1)
        if ffill:
            fr = w.rowsBetween(Window.unboundedPreceding, 0)
            p = p.withColumns({f"{c}__ff": F.last(c, ignorenulls=True).over(fr) for c in ffill})
        p = p.withColumns(build(w))
        return rows_pass(p, [_KEY], order, True) if rows_pass else p

    def blocked(part: DataFrame) -> DataFrame:
        p = keep(with_positions(part, [_KEY], order))
        if ffill:
            p = forward_fill(p, [_KEY], ffill, block_rows, suffix="__ff")
        return blocked_window(p, [_KEY], build, lookback, lookahead, block_rows, rows_pass=rows_pass)

    if not any_large:
        return plain(df).drop(_KEY)
    return (plain(df.join(large, _KEY, "left_anti"))
            .unionByName(blocked(df.join(large, _KEY, "left_semi"))).drop(_KEY))
