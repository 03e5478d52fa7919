"""Rolling mean/std over many columns at once (W4) with numpy in tasks.

Spark evaluates a sliding ROWS frame by re-aggregating the whole frame for
every row, interpreted, once per window function; W4 asks for 2 statistics
x 3 windows x every numeric column (about 100 functions on the robot
series), which makes that the slowest part of the robot pipeline. Here the
series is hash-partitioned by key and sorted inside partitions, and one
``mapInArrow`` pass computes every (column, window) pair: per frame a
sequential sum (mean) and Welford moment updates (sample std), vectorised over
columns and rows, with rows of other keys masked out. A batch needs only the
``max(windows) - 1`` rows before it, so these are all that a task holds of a
key, however long it is; the arrays of a step are small enough for the
processor's cache. Callers that cut long keys into blocks (with halo rows,
:func:`gearsight.operators.ordered.halo_blocks`) pass the block as part of the key.

Semantics equal pandas ``rolling(n, min_periods=1)``: nulls are skipped,
the mean of an all-null frame is null, std needs two values and a missing
std is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

STEP_VALUES = 1 << 14       # values (columns x rows) handled at once


def _flat(columns: list[pa.Array]) -> list[pa.Array]:
    return [x for c in columns for x in (_flat(c.flatten()) if pa.types.is_struct(c.type) else [c])]


def _changes(keys: list[pa.Array]) -> np.ndarray:
    """Whether each row but the first has another key than the row before it; nulls are alike."""
    out = np.zeros(max(0, len(keys[0]) - 1), bool)
    for c in keys:
        a, b = c.slice(1), c.slice(0, max(0, len(c) - 1))
        out |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out |= pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return out


def _moments(x: np.ndarray, ok: np.ndarray, place: np.ndarray, n: int, as_window: bool):
    """Count, sum and second moment of each row's frame of ``n`` rows. ``x`` and ``ok``
    (columns x rows) have rows before those of ``place``, a row's number in its key."""
    rows, before = len(place), x.shape[1] - len(place)
    cnt, total, avg, m2 = (np.zeros((len(x), rows)) for _ in range(4))
    # oldest to newest, one frame position at a time: the same summation and
    # moment-update order as an SQL engine aggregating the frame, so results
    # agree to the last bits
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for off in range(n - 1, -1, -1):
            here = slice(before - off, before - off + rows)
            known = ok[:, here] & (place >= off)
            v = np.where(known, x[:, here], 0.0)
            cnt += known
            total += v
            delta = np.where(known, v - avg, 0.0)
            step = delta / np.maximum(cnt, 1)
            new = avg + step
            m2 = np.where(known, m2 + delta * (delta - step if as_window else v - new), m2)
            avg = np.where(known, new, avg)
    return cnt, total, m2


class _Rolling:
    """Statistics of consecutive batches; keeps the rows that later frames reach."""

    def __init__(self, k: int, windows: list[int], as_window: bool):
        self.windows, self.as_window, self.reach = windows, as_window, max(windows) - 1
        self.x, self.ok = np.zeros((k, self.reach)), np.zeros((k, self.reach), bool)
        self.last, self.run = None, 0       # key of the last row, rows of it so far

    def _places(self, keys: list[pa.Array], rows: int) -> np.ndarray:
        keys = _flat(keys)
        first = self.last is None or bool(_changes([pa.concat_arrays([a, b.slice(0, 1)]) for a, b in zip(self.last, keys)])[0])
        start = np.where(np.append(first, _changes(keys)), np.arange(rows), -self.run)
        start = np.maximum.accumulate(start)
        place = np.arange(rows) - start
        self.last, self.run = [c.slice(rows - 1) for c in keys], int(place[-1]) + 1
        return place

    def stats(self, keys: list[pa.Array], columns: list[pa.Array]) -> list[pa.Array]:
        """Per window and column the mean, then the std."""
        rows, k = len(keys[0]), len(columns)
        place = self._places(keys, rows)
        x, ok = np.empty((k, self.reach + rows)), np.empty((k, self.reach + rows), bool)
        x[:, :self.reach], ok[:, :self.reach] = self.x, self.ok
        for i, c in enumerate(columns):
            x[i, self.reach:] = pc.cast(c, pa.float64(), safe=False).to_numpy(zero_copy_only=False)
            ok[i, self.reach:] = c.is_valid().to_numpy(zero_copy_only=False)
        if not self.as_window:
            ok &= ~np.isnan(x)
        self.x, self.ok = x[:, rows:].copy(), ok[:, rows:].copy()
        out = np.empty((2 * len(self.windows) * k, rows))
        none = np.empty((len(self.windows) * k, rows), bool)
        size = max(64, STEP_VALUES // max(1, k))
        for at in range(0, rows, size):
            end = min(rows, at + size)
            part = slice(at, end + self.reach)
            for j, n in enumerate(self.windows):
                cnt, total, m2 = _moments(x[:, part], ok[:, part], place[at:end], n, self.as_window)
                none[j * k:(j + 1) * k, at:end] = cnt == 0
                to = out[2 * j * k:2 * (j + 1) * k, at:end]
                with np.errstate(invalid="ignore", divide="ignore"):
                    to[::2] = total / cnt
                    to[1::2] = np.where(cnt >= 2, np.sqrt(m2 / (cnt - 1)), 0.0)
        nan = not self.as_window
        return [pa.array(v, mask=none[i // 2] if i % 2 == 0 else None, from_pandas=nan) for i, v in enumerate(out)]


def rolling_mean_std(df: DataFrame, key: list[str], order: str | list[str], cols: list[str], windows: list[int],
                     placed: bool = False, as_window: bool = False) -> DataFrame:
    """Add ``<c>_ma_<n>`` and ``<c>_std_<n>`` for every column and window.
    ``placed``: rows of equal key already share a partition. ``as_window``: NaN is a
    value, and figures are those of Spark's window functions to the last bit."""
    names = [f"{c}_{s}_{n}" for n in windows for c in cols for s in ("ma", "std")]
    if not names:
        return df
    schema = T.StructType(df.schema.fields + [T.StructField(x, T.DoubleType()) for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _Rolling(len(cols), windows, as_window)
        for batch in batches:
            if batch.num_rows:
                at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                stats = rolling.stats([at[c] for c in key], [at[c] for c in cols])
                yield pa.RecordBatch.from_arrays([*batch.columns, *stats], names=[*batch.schema.names, *names])

    df = df if placed else df.repartition(*key)
    order = [order] if isinstance(order, str) else order
    return df.sortWithinPartitions(*key, *order).mapInArrow(run, schema)
