"""Long tag history -> regular wide series (A1 pivot, A2 resample, W6 fill).

pivot:     mean of duplicates per (device, timestamp, sensor) — a groupBy
           with a declared value list, so no extra job finds the columns.
resample:  mean of those means per fixed bin (left-closed, left label);
           bins start at midnight of the first day (pandas' default
           origin; for intervals dividing a day this is epoch alignment,
           otherwise one scalar aggregate finds the first day).
blocks:    positions (bin numbers, or ranks where there are no bins) are cut into
           blocks of ``block_rows``. Per (key, block) one small row says the first
           and last position and, per column, the first and last known value; a
           running scan over these rows in both directions gives every block what
           lies before and after it. A key with any number of bins is spread over
           as many window partitions as it has blocks.
spine:     every bin between a key's first and last bin is present, empty ones as
           nulls: each present bin emits the empty bins up to the next present one
           of its block or to the block's end, a block's first bin also those from
           the block's start, and wholly empty blocks come from the small rows.
gap fill:  linear by position between neighbours, ends extended with the
           nearest value; a column that is null throughout stays null. The
           neighbours are running values of the block, else the carried ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearsight.operators.ordered import with_positions

BLOCK_ROWS = 1 << 16        # positions of one key that one window partition holds

US_PER = {"s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def interval_micros(interval: str) -> int:
    """'5s', '15m', '6h', '1d' -> microseconds."""
    n, unit = int(interval[:-1]), interval[-1].lower()
    return n * US_PER[unit]


def _pivot_aggs(name_col: str, value_col: str, names: list[str]):
    return [F.avg(F.when(F.col(name_col) == n, F.col(value_col))).alias(n) for n in names]


def pivot_mean(df: DataFrame, key: list[str], ts: str, name_col: str, value_col: str,
               names: list[str]) -> DataFrame:
    """A1: one row per (key, ts), one column per declared name, mean of
    duplicates — one aggregate with a conditional mean per name (the same
    result as ``pivot``, which would plan two aggregates)."""
    return df.groupBy(*key, ts).agg(*_pivot_aggs(name_col, value_col, names))


def pivot_resample_mean(long: DataFrame, key: list[str], ts: str, name_col: str, value_col: str,
                        names: list[str], interval: str, origin_us: int | str = "start_day",
                        out_ts: str = "ts", fill: bool = False, block_rows: int = BLOCK_ROWS,
                        pos_col: str | None = None) -> DataFrame:
    """A1 + A2 (+ W6): per-timestamp means are combined in the map tasks and shuffled
    by (key, bin, timestamp), so no bin of raw rows meets in one task; the per-bin
    means of those means are a second, small aggregate. Then spine and fill."""
    iv = interval_micros(interval)
    if origin_us == "start_day":
        origin_us = start_day_origin(long, ts) if (86_400_000_000 % iv) else 0
    rows = long.withColumn("_bin", _bin_number(ts, iv, origin_us))
    per_ts = rows.groupBy(*key, "_bin", ts).agg(*_pivot_aggs(name_col, value_col, names))
    return _series(per_ts, key, names, iv, origin_us, out_ts, fill, block_rows, pos_col)


def _bin_number(ts: str, iv_us: int, origin_us: int) -> Column:
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.floor((us - F.lit(origin_us)) / F.lit(iv_us))


def _series(rows: DataFrame, key: list[str], names: list[str], iv: int, origin_us: int, out_ts: str,
            fill: bool, block_rows: int, pos_col: str | None) -> DataFrame:
    """Means per bin of ``rows`` (numbered ``_bin``), regular from first to last bin."""
    binned = rows.groupBy(*key, "_bin").agg(*[F.avg(F.col(f"`{n}`")).alias(n) for n in names])
    out = block_series(binned, key, "_bin", names, fill=fill, block_rows=block_rows)
    start = F.timestamp_micros(F.lit(origin_us) + F.col("_bin") * F.lit(iv)).cast("timestamp_ntz")
    return out.select(*key, start.alias(out_ts), *[F.col(f"`{n}`") for n in names],
                      *([F.col("_bin").alias(pos_col)] if pos_col else []))


def start_day_origin(df: DataFrame, ts: str) -> int:
    """pandas' default origin: midnight of the first day in the data (one
    scalar aggregate). Only matters for intervals that do not divide a day."""
    first = df.agg(F.min(F.unix_micros(F.date_trunc("day", F.col(ts)).cast("timestamp")))).first()[0]
    return int(first or 0)


def resample_mean(wide: DataFrame, key: list[str], ts: str, names: list[str], interval: str,
                  origin_us: int | str = 0, out_ts: str = "ts", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A2: mean per bin of the per-timestamp means, with a full spine of bins.
    ``origin_us="start_day"`` aligns bins like pandas for any interval."""
    iv = interval_micros(interval)
    if origin_us == "start_day":
        origin_us = start_day_origin(wide, ts) if (86_400_000_000 % iv) else 0
    return _series(wide.withColumn("_bin", _bin_number(ts, iv, origin_us)), key, names, iv, origin_us, out_ts,
                   False, block_rows, None)


def _between(prev: Column, nxt: Column, p: Column) -> Column:
    """The value at position ``p`` on the line from one known (p, v) to the next;
    beyond the first or last known value, that value."""
    line = prev["v"] + (nxt["v"] - prev["v"]) * (p - prev["p"]) / (nxt["p"] - prev["p"])
    return F.when(prev.isNotNull() & nxt.isNotNull(), line).otherwise(F.coalesce(prev["v"], nxt["v"]))


def block_series(rows: DataFrame, key: list[str], pos: str, names: list[str], fill: bool = True, spine: bool = True,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows(*key, pos, *names)`` with unique integer positions per key: with
    ``spine`` every position from a key's first to its last, with ``fill`` nulls
    replaced on the line between their known neighbours.

    Work per key is split into blocks of positions; only one small row per (key,
    block) is seen by a window over the whole key. Null keys are keys like any other.
    """
    known = [F.when(F.col(f"`{n}`").isNotNull(), F.struct(F.col(pos).alias("p"), F.col(f"`{n}`").alias("v"))) for n in names]
    ids = range(len(names) if fill else 0)
    d = (rows.withColumn("_key", F.struct(*key)).withColumn("_blk", F.floor(F.col(pos) / F.lit(block_rows)))
         .drop(*key))

    # per block: ends, first and last known values; then both scans over the blocks
    blocks = d.groupBy("_key", "_blk").agg(
        F.min(pos).alias("_lo"), *[F.min(known[i]).alias(f"_first{i}") for i in ids],
        *[F.max(known[i]).alias(f"_last{i}") for i in ids])
    onward = Window.partitionBy("_key").orderBy("_blk")
    before = onward.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_key").orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.withColumns(
        {"_next_lo": F.lead("_lo").over(onward), "_next_blk": F.lead("_blk").over(onward),
         "_prev_blk": F.lag("_blk").over(onward)}
        | {f"_before{i}": F.last(f"_last{i}", ignorenulls=True).over(before) for i in ids}
        | {f"_after{i}": F.last(f"_first{i}", ignorenulls=True).over(after) for i in ids})

    # per row: the known values around it, in its block or carried
    inside = Window.partitionBy("_key", "_blk")
    w = inside.orderBy(pos)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    to_come = inside.orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ["_next_lo", "_prev_blk", *[f"_{x}{i}" for i in ids for x in ("before", "after")]]
    d = d.join(carry.select("_key", "_blk", *carried), ["_key", "_blk"])
    d = d.withColumns(
        {"_next_pos": F.lead(pos).over(w), "_prev_pos": F.lag(pos).over(w)}
        | {f"_p{i}": F.coalesce(F.last(known[i], ignorenulls=True).over(so_far), F.col(f"_before{i}")) for i in ids}
        | {f"_n{i}": F.coalesce(F.last(known[i], ignorenulls=True).over(to_come), F.col(f"_after{i}")) for i in ids})

    def span(lo: Column, hi: Column, side: int) -> Column:
        at = F.when(lo <= hi, F.sequence(lo, hi))
        return F.transform(F.coalesce(at, F.array().cast("array<bigint>")), lambda x: F.struct(x.alias("p"), F.lit(side).alias("side")))

    here = F.col(pos)
    first, last = F.col("_blk") * block_rows, F.col("_blk") * block_rows + (block_rows - 1)
    places = span(here, here, 0)
    if spine:
        lead_in = F.when(F.col("_prev_pos").isNull() & F.col("_prev_blk").isNotNull(), first).otherwise(here)
        until = F.coalesce(F.col("_next_pos") - 1, F.when(F.col("_next_lo").isNotNull(), F.least(F.col("_next_lo") - 1, last)), here)
        places = F.concat(span(lead_in, here - 1, -1), places, span(here + 1, until, 1))
    out = d.withColumn("_at", F.explode(places))
    p, side, values = F.col("_at.p"), F.col("_at.side"), []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        if fill:
            inner = F.when((side == 0) & c.isNotNull(), c).otherwise(_between(F.col(f"_p{i}"), F.col(f"_n{i}"), p))
            ahead = _between(F.col(f"_before{i}"), F.coalesce(known[i], F.col(f"_n{i}")), p)
            values.append(F.when(side == -1, ahead).otherwise(inner).alias(n))
        else:
            values.append(F.when(side == 0, c).alias(n))
    out = out.select("_key.*", p.alias(pos), *values)
    if not spine:
        return out

    # blocks without any row: from the last block before them
    empty = carry.where(F.col("_next_blk") > F.col("_blk") + 1).select(
        "_key", F.explode(F.sequence(F.col("_blk") + 1, F.col("_next_blk") - 1)).alias("_blk"),
        *[F.coalesce(f"_last{i}", f"_before{i}").alias(f"_p{i}") for i in ids], *[F.col(f"_after{i}").alias(f"_n{i}") for i in ids])
    empty = (empty.repartition("_key", "_blk")
             .withColumn(pos, F.explode(F.sequence(first, last))))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    gaps = [(_between(F.col(f"_p{i}"), F.col(f"_n{i}"), here) if fill else F.lit(None)).cast(kinds[n]).alias(n)
            for i, n in enumerate(names)]
    return out.unionByName(empty.select("_key.*", pos, *gaps))


def gap_fill_linear(series: DataFrame, key: list[str], ts: str, names: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Linear interpolation by row position, both ends extended. ``ts`` is unique per key."""
    numbered = with_positions(series.withColumn("_key", F.struct(*key)), ["_key"], [ts]).drop("_key")
    rows = numbered.select(*key, "_pos", ts, *[F.col(f"`{n}`") for n in names])
    filled = block_series(rows.drop(ts), key, "_pos", names, spine=False, block_rows=block_rows)
    times = rows.select(F.struct(*key).alias("_key"), "_pos", ts)
    return (filled.withColumn("_key", F.struct(*key)).join(times, ["_key", "_pos"])
            .select(*key, ts, *[F.col(f"`{n}`") for n in names]))


def regular_series(long: DataFrame, key: list[str], ts: str, name_col: str, value_col: str,
                   names: list[str], interval: str | None, fill: bool = True,
                   origin_us: int | str = "start_day", block_rows: int = BLOCK_ROWS,
                   pos_col: str | None = None) -> DataFrame:
    """A1 -> A2 -> W6 in one lazy plan. ``pos_col`` adds the bin number."""
    if interval:
        return pivot_resample_mean(long, key, ts, name_col, value_col, names, interval, origin_us, ts, fill,
                                   block_rows, pos_col)
    wide = pivot_mean(long, key, ts, name_col, value_col, names)
    return gap_fill_linear(wide, key, ts, names, block_rows) if fill else wide
