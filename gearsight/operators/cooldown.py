"""Greedy cool-down (W13): a match fires unless an earlier *fired* alert of
the same (rule, device) lies less than the cool-down before it.

Each decision depends on the previous decision, so it is not a window
function. Done exactly, with no key's matches or chunks in one task:

1. Matches are computed and written once. Of a key's matches of one time only
   the first can fire, so the rest works on narrow (key, time) rows. Keys of
   more than ``chunk_rows`` of them get exact positions and are cut into chunks
   of that many rows; all others are one chunk.
2. The state between chunks is "blocked until B". What a chunk makes of it is a
   step function: the first row at or after B fires, and its chain of next fires
   ends in an exit state; if there is no such row, B stays. B lies less than the
   cool-down behind the chunk's first row, so the function needs few steps. All
   chains of a frame are followed at once by pointer doubling.
3. Functions of neighbouring chunks are composed pairwise, pairs of pairs, and so
   on: rounds follow the logarithm of the largest key's chunks. Then the entry
   state of each whole key (nothing blocked) is handed down through the pairs:
   the left half gets the pair's state, the right half what the left makes of it.
4. Every chunk, now with its own entry state, follows its chain; those rows fire,
   and pick their matches out of the written ones.

Where no key has several chunks, steps 2 and 3 have nothing to do. Frames are
worked on with numpy, all groups of an Arrow batch at once. Timestamps are int64
microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.operators.ordered import with_positions
from gearsight.session import written

CHUNK_ROWS = 1 << 16        # (key, time) rows of one chunk


def _us(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def complete_groups(batches: Iterator[pd.DataFrame], cols: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut a sorted partition's Arrow batches so no group spans two frames.
    The open group is kept as a list of frames and joined once, so a long group
    costs its length."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        last = np.ones(len(pdf), dtype=bool)
        for c in cols:
            v = pdf[c].to_numpy()
            last &= v == v[-1]
        cut = len(pdf) - int(np.argmin(last[::-1])) if not last.all() else 0
        if held and (cut or any(held[-1][c].iloc[-1] != pdf[c].iloc[0] for c in cols)):
            # the held group ends in this frame, or before it
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
        elif cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _first_at_or_after(g: np.ndarray, t: np.ndarray, qg: np.ndarray, qt: np.ndarray) -> np.ndarray:
    """Index of the first row of (g, t), sorted, that is not before each (qg, qt)."""
    n = len(t)
    order = np.lexsort((np.arange(n + len(qt)) < n, np.concatenate([t, qt]), np.concatenate([g, qg])))
    rows_before = np.cumsum(order < n)
    out = np.empty(len(qt), np.int64)
    asked = order >= n
    out[order[asked] - n] = rows_before[asked]
    return out


def _groups(pdf: pd.DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group number per row, and each group's first row and end."""
    new = np.zeros(len(pdf), dtype=bool)
    new[:1] = True
    for c in cols:
        v = pdf[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    start = np.flatnonzero(new)
    return np.cumsum(new) - 1, start, np.append(start[1:], len(pdf))


def _next_fires(pdf: pd.DataFrame):
    """Groups, times, cool-downs and the next fire after each row (``n``: none in its chunk)."""
    g, start, end = _groups(pdf, ["_k", "_chunk"])
    t, cd = pdf["_t"].to_numpy(np.int64), pdf["_cd"].to_numpy(np.int64)
    nxt = np.maximum(_first_at_or_after(g, t, g, t + cd), np.arange(len(t)) + 1)
    return g, start, end, t, cd, np.where(nxt >= end[g], len(t), nxt)


def _steps(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each chunk's function as steps: B up to ``_upto`` leads to ``_exit``."""
    for pdf in complete_groups(it, ["_k", "_chunk"]):
        g, start, end, t, cd, nxt = _next_fires(pdf)
        n, idx = len(pdf), np.arange(len(pdf))
        p = np.where(nxt >= n, idx, nxt)
        while not np.array_equal(q := p[p], p):         # pointer doubling to the chain's end
            p = q
        groups = np.arange(len(start))
        beyond = _first_at_or_after(g, t, groups, t[start] + cd[start])
        needed = idx <= np.minimum(beyond, end - 1)[g]
        yield _fewest_steps(pd.DataFrame({"_k": pdf["_k"], "_g": pdf["_chunk"], "_upto": t, "_exit": t[p] + cd,
                                          "_reach": (t[start] + cd[start])[g]})[needed])


def _fewest_steps(steps: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring steps of equal exit as one."""
    k, g, x = steps["_k"].to_numpy(), steps["_g"].to_numpy(), steps["_exit"].to_numpy()
    last = np.ones(len(steps), dtype=bool)
    last[:-1] = (k[1:] != k[:-1]) | (g[1:] != g[:-1]) | (x[1:] != x[:-1])
    return steps[last].reset_index(drop=True)


def _composed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Functions of pairs: the right half's after the left half's. ``_reach`` bounds
    the states that can enter, so steps beyond the first at or after it are not needed."""
    for pdf in complete_groups(it, ["_k", "_up"]):
        pair, start, end = _groups(pdf, ["_k", "_up"])
        right = (pdf["_g"].to_numpy(np.int64) & 1) == 1
        upto, exits = pdf["_upto"].to_numpy(np.int64), pdf["_exit"].to_numpy(np.int64)
        at = _first_at_or_after(pair[right], upto[right], pair[~right], exits[~right])
        of = np.append(pair[right], -1)
        hit = of[at] == pair[~right]                    # else it passes the right half as it is
        out = exits.copy()
        out[~right] = np.where(hit, np.append(exits[right], 0)[at], exits[~right])
        reach = pdf["_reach"].to_numpy(np.int64)[start]
        beyond = _first_at_or_after(pair, upto, np.arange(len(start)), reach)
        needed = np.arange(len(pdf)) <= np.minimum(beyond, end - 1)[pair]
        yield _fewest_steps(pd.DataFrame({"_k": pdf["_k"], "_g": pdf["_up"], "_upto": upto, "_exit": out,
                                          "_reach": reach[pair]})[needed])


def _fired(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in complete_groups(it, ["_k", "_chunk"]):
        g, start, end, t, _, nxt = _next_fires(pdf)
        entry = pdf["_entry"].to_numpy(np.int64)[start]
        cur = _first_at_or_after(g, t, np.arange(len(start)), entry)
        cur = cur[cur < end]
        fired = np.zeros(len(pdf), dtype=bool)
        while len(cur):                                 # one round per fire of the chunk with most
            fired[cur] = True
            cur = nxt[cur]
            cur = cur[cur < len(pdf)]
        yield pdf.loc[fired, ["_k", "_t", "_tb"]]


_STEP = "_k string, _g long, _upto long, _exit long, _reach long"
_OPEN = -(1 << 62)      # a state that blocks nothing


def _entries(chunked: DataFrame, rounds: int) -> DataFrame:
    """``(_k, _chunk, _entry)``: the state in which each chunk of a large key is entered."""
    steps = (chunked.select("_k", "_chunk", "_t", "_cd").repartition("_k", "_chunk")
             .sortWithinPartitions("_k", "_chunk", "_t").mapInPandas(_steps, _STEP))
    levels = [written(steps)]
    for _ in range(rounds):
        pairs = levels[-1].withColumn("_up", F.shiftright("_g", 1)).repartition("_k", "_up")
        levels.append(written(pairs.sortWithinPartitions("_k", "_up", "_g", "_upto").mapInPandas(_composed, _STEP)))
    state = levels.pop().select("_k", "_g").distinct().withColumn("_entry", F.lit(_OPEN).cast("long"))
    for steps in reversed(levels):
        halves = steps.select("_k", "_g").distinct().withColumn("_up", F.shiftright("_g", 1))
        state = state.withColumnRenamed("_g", "_up")
        left = steps.where(F.col("_g") % 2 == 0).withColumn("_up", F.shiftright("_g", 1)).join(state, ["_k", "_up"])
        after = left.groupBy("_k", "_up").agg(F.coalesce(
            F.min_by("_exit", F.when(F.col("_upto") >= F.col("_entry"), F.col("_upto"))), F.max("_entry")).alias("_after"))
        state = written(halves.join(state, ["_k", "_up"]).join(after, ["_k", "_up"]).select(
            "_k", "_g", F.when(F.col("_g") % 2 == 0, F.col("_entry")).otherwise(F.col("_after")).alias("_entry")))
    return state.withColumnRenamed("_g", "_chunk")


def greedy_cooldown(matches: DataFrame, key: list[str], ts: str, tiebreak: str,
                    cooldown_us, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Keep the matches that fire. ``cooldown_us`` is a Column or int (constant
    within a key); ``tiebreak`` (integral, unique at a time) orders matches with
    equal ts. Matches without a time are left out. Without a cool-down (null, 0 or
    less) every match fires. The matches are written once while planning."""
    cd = cooldown_us if not isinstance(cooldown_us, int) else F.lit(cooldown_us)
    m = written(matches.select(
        "*", F.to_json(F.struct(*[F.col(k) for k in key])).alias("_k"),
        _us(ts).alias("_t"), F.col(tiebreak).cast("long").alias("_tb"),
        F.coalesce(cd.cast("long"), F.lit(0)).alias("_cd")).where(F.col("_t").isNotNull()))
    first = written(m.where("_cd > 0").groupBy("_k", "_t").agg(F.min("_tb").alias("_tb"), F.max("_cd").alias("_cd")))
    large = first.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk_rows)
    most = large.agg(F.max("_n")).first()[0]
    entry = F.lit(_OPEN).cast("long").alias("_entry")
    if most is None:
        chunked = first.withColumn("_chunk", F.lit(0).cast("long")).select("*", entry)
    else:
        of_large = written(with_positions(first.join(large.select("_k"), "_k", "left_semi"), ["_k"], ["_t"])
                           .withColumn("_chunk", F.floor(F.col("_pos") / chunk_rows)).drop("_pos"))
        rounds = (-(-most // chunk_rows) - 1).bit_length()
        entered = of_large.join(_entries(of_large, rounds), ["_k", "_chunk"])
        small = first.join(large.select("_k"), "_k", "left_anti").withColumn("_chunk", F.lit(0).cast("long"))
        chunked = small.select("*", entry).unionByName(entered)
    fired = (chunked.repartition("_k", "_chunk").sortWithinPartitions("_k", "_chunk", "_t")
             .mapInPandas(_fired, "_k string, _t long, _tb long"))
    kept = m.where("_cd > 0").join(fired, ["_k", "_t", "_tb"], "left_semi")
    return kept.unionByName(m.where("_cd <= 0")).select(*matches.columns)
