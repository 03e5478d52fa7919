"""Stateful stream operators (ST4 rule cool-down, ST5 bounded buffers, ST7 the
last rows a prediction needs).

All use ``applyInPandasWithState``: Spark routes each key's rows of a
micro-batch to one call together with that key's state from the state
store (checkpointed, so a restarted query resumes where it stopped).

Event-time policy (ours; the reference has none): within a batch rows are
taken in event-time order; a row older than the newest row already
processed for its key is late — it comes out marked ``late``, is counted,
and never decides anything. For in-order input, stream and batch give the
same alerts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COOLDOWN_BUCKETS = 1024     # groups that the keys of a cool-down are dealt to; fixed for a stream's life
COOLDOWN_STATE = "key array<string>, last_fire array<long>, last_seen array<long>, late array<long>"
UNDATED, NO_TIEBREAK = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _chain(t: np.ndarray, cd: int, last_fire: int | None) -> list[int]:
    """Positions that fire among one key's times (ascending)."""
    nxt = np.maximum(np.searchsorted(t, t + cd, side="left"), np.arange(1, len(t) + 1)).tolist()
    i = 0 if last_fire is None else int(np.searchsorted(t, last_fire + cd, side="left"))
    fired = []
    while i < len(t):                 # fires are >= cooldown apart
        fired.append(i)
        i = nxt[i]
    return fired


def _cooldown_fn(bucket, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pdf = pd.concat(list(pdfs), ignore_index=True)
    known = {k: list(v) for k, *v in zip(*state.get)} if state.exists else {}
    codes, keys = pd.factorize(pdf["_key"])
    t, tb, cd = pdf["_t"].to_numpy(np.int64), pdf["_tb"].to_numpy(np.int64), pdf["_cd"].to_numpy()
    order = np.lexsort((tb, t, t == UNDATED, codes))      # by key and time, undated rows last
    t, cd = t[order], cd[order]
    ends = np.cumsum(np.bincount(codes, minlength=len(keys))).tolist()
    picked, late_rows = [], []
    for key, lo, hi in zip(keys, [0, *ends], ends):
        last_fire, last_seen, late = known.get(key, (None, None, 0))
        at = np.arange(lo, hi)
        if last_seen is not None:
            is_late = (t[lo:hi] < last_seen) & (t[lo:hi] != UNDATED)
            late += int(is_late.sum())
            late_rows += at[is_late].tolist()
            at = at[~is_late]
        if len(at):
            own = t[at]
            fired = _chain(own, int(cd[at[0]]), last_fire)
            if fired:
                last_fire = int(own[fired[-1]])
            picked += at[fired].tolist()
            last_seen = int(max(own[-1], last_seen or own[-1]))
        known[key] = [last_fire, last_seen, late]
    state.update((list(known), *map(list, zip(*known.values()))))
    told = pdf.take(order[np.array(picked + late_rows, np.int64)]).drop(columns=["_bucket", "_key", "_t", "_tb", "_cd"])
    yield told.assign(outcome=["fired"] * len(picked) + ["late"] * len(late_rows))


def stream_cooldown(matches: DataFrame, key: list[str], ts: str, tiebreak: str, cooldown_us_col: str,
                    buckets: int = COOLDOWN_BUCKETS) -> DataFrame:
    """ST4: greedy cool-down per key on a stream of rule matches: the matches that
    fire and those that came late, told apart by ``outcome`` (fired, late).

    Keys are dealt to ``buckets`` by their hash; a call takes one bucket's rows of a
    micro-batch with the state of its keys, so that calls do not grow with the keys.
    Columns of ``matches`` pass through Python: select those wanted first."""
    longs = [f.name for f in matches.schema if isinstance(f.dataType, T.LongType)]
    m = matches.withColumns({
        "_key": F.to_json(F.struct(*key)),
        "_t": F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(UNDATED)),
        "_tb": F.coalesce(F.col(tiebreak).cast("long"), F.lit(NO_TIEBREAK)),
        "_cd": F.col(cooldown_us_col).cast("long")})
    m = m.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
    # a null among them would turn a frame's longs into doubles
    m = m.withColumns({f"_no_{c}": F.col(c).isNull() for c in longs} | {c: F.coalesce(c, F.lit(0).cast("long")) for c in longs})
    out_schema = T.StructType([*matches.schema.fields, *[T.StructField(f"_no_{c}", T.BooleanType()) for c in longs],
                               T.StructField("outcome", T.StringType())])
    told = m.groupBy("_bucket").applyInPandasWithState(
        _cooldown_fn, out_schema, COOLDOWN_STATE, "Append", GroupStateTimeout.NoTimeout)
    return told.withColumns({c: F.when(~F.col(f"_no_{c}"), F.col(c)) for c in longs}).drop(*[f"_no_{c}" for c in longs])


BUFFER_STATE = "ts array<long>, health array<double>"
BUFFER_OUT = "device_id string, buffer_size long, oldest_us long, newest_us long, health_mean double"


def _buffer_fn(cap: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["_t", "_tb"], kind="stable")
        ts, h = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        ts = np.concatenate([np.asarray(ts, dtype=np.int64), pdf["_t"].to_numpy(np.int64)])
        h = np.concatenate([np.asarray(h, dtype=float), pdf["health_score"].to_numpy(float)])
        order = np.argsort(ts, kind="stable")
        ts, h = ts[order][-cap:], h[order][-cap:]
        state.update((ts.tolist(), h.tolist()))
        yield pd.DataFrame({"device_id": [key[0]], "buffer_size": [len(ts)], "oldest_us": [int(ts[0])],
                            "newest_us": [int(ts[-1])], "health_mean": [float(np.mean(h))]})
    return fn


def stream_buffers(readings: DataFrame, cap: int = 100) -> DataFrame:
    """ST5: the newest ``cap`` readings per device kept in state (a bounded
    list per key); each batch emits the buffer summary of touched devices."""
    r = readings.select("device_id", "health_score",
                        F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"),
                        F.col("event_id").cast("long").alias("_tb"))
    return r.groupBy("device_id").applyInPandasWithState(
        _buffer_fn(cap), BUFFER_OUT, BUFFER_STATE, "Append", GroupStateTimeout.NoTimeout)


SEQUENCE_STATE = "t array<long>, tb array<long>, x array<double>"


def _sequence_fn(length: int, width: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs), ignore_index=True)
        t, tb = pdf["_t"].to_numpy(np.int64), pdf["_tb"].to_numpy(np.int64)
        x = np.array(pdf["_x"].tolist(), dtype=float).reshape(len(pdf), width)
        if state.exists:
            old = state.get
            t, tb = np.concatenate([old[0], t]).astype(np.int64), np.concatenate([old[1], tb]).astype(np.int64)
            x = np.concatenate([np.array(old[2], dtype=float).reshape(-1, width), x])
        keep = np.lexsort((tb, t))[-length:]
        t, tb, x = t[keep], tb[keep], x[keep]
        flat = x.ravel().tolist()
        state.update((t.tolist(), tb.tolist(), flat))
        yield pd.DataFrame({"device_id": [key[0]], "ts_us": [int(t[-1])], "n_rows": [len(t)],
                            "seq": [flat if len(t) >= length else None]})
    return fn


def stream_sequences(rows: DataFrame, features: list[str], length: int) -> DataFrame:
    """ST7: the newest ``length`` feature rows per device, kept in state, as the
    vector a model reads (row-major, oldest first; null while there are fewer).
    Each batch emits the devices it touched. Rows are ordered by (ts, event_id),
    whatever batch they come in; ``rows`` needs device_id, ts, event_id, features."""
    r = rows.select("device_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"),
                    F.col("event_id").cast("long").alias("_tb"),
                    F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
    held = r.where("_t is not null").groupBy("device_id").applyInPandasWithState(
        _sequence_fn(length, len(features)), "device_id string, ts_us long, n_rows long, seq array<double>",
        SEQUENCE_STATE, "Append", GroupStateTimeout.NoTimeout)
    return held.select("device_id", F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts"), "n_rows", "seq")
