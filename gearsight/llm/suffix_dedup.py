"""Removal of byte strings of ``length`` or more that occur twice, by suffix order.

Sharding. Each window of ``length`` bytes is sent where its *anchor* goes: the
least hash among its ``ANCHOR``-byte strings. Equal windows have equal anchors,
so no repeat is split. The windows of a text that share an anchor make one
segment; all windows of a text lie in exactly one segment.

1. One pass over the texts lists segments as (anchor, content hash, place).
2. Equal segments fall together and carry how often they occur: all windows of
   one that occurs twice are repeats. An anchor with a single content that does
   not hold the anchor twice needs no sorting.
3. The other contents are cut from their texts, dealt to shards by anchor, and
   each shard is sorted by external induced sorting with common prefixes: a
   window is a repeat if it shares ``length`` bytes with a neighbour.
4. Repeated windows go back to the texts they were cut from, and each text
   drops the union of its repeats.

Contents of one anchor that exceed ``HOT_BYTES`` (a passage found in very many
different surroundings) are never sorted together: they are texts of a new round,
whose anchors are least under another seed and so mostly lie in the surroundings.
What is still hot after ``ROUNDS`` is told by 128-bit hashes of its windows, which
Spark counts. So no group in a task is larger than ``2 * HOT_BYTES``, at any size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import id_and_text, slices, written
from gearsight.llm.induced_sort import suffix_order

LENGTH = 400
ANCHOR = 32
SHARD_BYTES = 4 << 20           # bytes of a shard, on average
SORT_MEMORY = 192 << 20         # queue bytes a sort keeps in memory
HOT_BYTES = 16 << 20            # content bytes of one anchor that are not sorted together
ROUNDS = 3                      # seeds tried before windows are hashed
WINDOWS = 1 << 16               # window hashes of one Arrow batch

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Segmenter:
    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR, seed: int = 0):
        self.length, self.anchor, self.seed = length, min(anchor, length), np.uint64(seed * 0xD6E8FEB86659FD93 % (1 << 64))
        n = _BLOCK + length + 1
        self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def _hashes(self, text: np.ndarray) -> np.ndarray:
        """A hash of each ``anchor``-byte string, in blocks of bounded size."""
        k, out = self.anchor, []
        with np.errstate(over="ignore"):
            for at in range(0, len(text) - k + 1, _BLOCK):
                part = text[at:at + _BLOCK + k - 1]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum((part + np.uint64(1)) * self.up[:len(part)], out=sums[1:])
                h = (sums[k:] - sums[:-k]) * self.down[:len(part) - k + 1] ^ self.seed
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                out.append(h ^ (h >> np.uint64(29)))
        return np.concatenate(out)

    def segments(self, raw: bytes) -> list[tuple[int, int, int, int, bool]]:
        """``(anchor, content hash, first window, last window, twice)`` per segment;
        ``twice``: the anchor occurs twice in the content."""
        from xxhash import xxh3_64_intdigest
        n, size = len(raw), self.length
        if n < size:
            return []
        h = self._hashes(np.frombuffer(raw, np.uint8))
        w, windows = size - self.anchor + 1, n - size + 1
        x = np.full(-(-len(h) // w) * w, np.uint64(2 ** 64 - 1))
        x[:len(h)] = h
        x = x.reshape(-1, w)
        ahead = np.minimum.accumulate(x, axis=1).ravel()
        back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:windows], ahead[w - 1:w - 1 + windows])
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        last = np.append(first[1:], windows) - 1
        out = []
        for a, b, v in zip(first.tolist(), last.tolist(), least[first]):
            out.append((int(v), xxh3_64_intdigest(raw[a:b + size]), a, b,
                        bool(np.count_nonzero(h[a:b + w] == v) > 1)))
        return out


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _raw(text) -> bytes:
    return text if isinstance(text, bytes) else text.encode()


def _placed(docs: DataFrame, length: int, anchor: int, seed: int) -> DataFrame:
    """Per row: id, text key, size, and the segments as parallel arrays."""
    def run(batches):
        from xxhash import xxh3_128_digest
        seg = Segmenter(length, anchor, seed)
        for batch in batches:
            for part, text in slices(batch):
                keys, sizes, cols = [], [], [[], [], [], [], []]
                for t in text:
                    raw = _raw(t)
                    keys.append(xxh3_128_digest(raw))
                    sizes.append(len(raw))
                    got = seg.segments(raw)
                    cols[0].append([_long(g[0]) for g in got])
                    cols[1].append([_long(g[1]) for g in got])
                    for i in (2, 3):
                        cols[i].append([g[i] for g in got])
                    cols[4].append([g[4] for g in got])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(cols[0], pa.list_(pa.int64())), pa.array(cols[1], pa.list_(pa.int64())),
                     pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int32())),
                     pa.array(cols[4], pa.list_(pa.bool_()))], names=["t", "n", "h", "c", "a", "b", "twice"])
    rows = docs.select("text").mapInArrow(run, "t binary, n long, h array<long>, c array<long>, a array<int>, "
                                               "b array<int>, twice array<boolean>")
    return (rows.select("t", F.explode(F.arrays_zip("h", "c", "a", "b", "twice")).alias("x"))
            .select("t", "x.*").groupBy("h", "c", "t", "a", "b", "twice").agg(F.count("*").alias("m")))


def _cut_texts(length: int):
    """Contents of the wanted segments, from their texts."""
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                raw = _raw(r["text"])
                rows += [(s["h"], s["c"], raw[s["a"]:s["b"] + length]) for s in r["want"]]
                if len(rows) > 4096:
                    yield _contents(rows)
                    rows = []
            if rows:
                yield _contents(rows)
    return run


def _contents(rows):
    h, c, raw = zip(*rows)
    return pa.record_batch([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(raw, pa.binary())],
                           names=["h", "c", "raw"])


def repeated_windows(contents: list[bytes], length: int, memory: int = SORT_MEMORY) -> list[np.ndarray]:
    """For each content, whether the window at each start occurs twice in all."""
    sizes = np.array([len(c) + 1 for c in contents])
    text = np.ones(int(sizes.sum()) + 1, np.uint16)         # 1 ends a content, 0 ends the text
    at = 0
    for c in contents:
        text[at:at + len(c)] = np.frombuffer(c, np.uint8)
        text[at:at + len(c)] += 2
        at += len(c) + 1
    text[-1] = 0
    order, common = suffix_order(text, length, memory)
    same = common >= length
    hit = np.zeros(len(text), bool)
    hit[order[same]] = True
    hit[order[:-1][same[1:]]] = True
    first = np.cumsum(sizes) - sizes
    # a window that reaches past its content's end is none
    return [hit[a:a + max(0, n - length)] for a, n in zip(first.tolist(), sizes.tolist())]


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[::2].tolist(), edges[1::2].tolist()


def _sorted_shards(length: int, most: int):
    """Rows sorted by shard and anchor -> per content the runs of repeated window
    starts. Whole anchors are sorted together, a new lot beyond ``most`` bytes."""
    def finish(rows):
        out = [(h, c, *_runs(mask)) for (h, c, _), mask in
               zip(rows, repeated_windows([r[2] for r in rows], length))]
        out = [o for o in out if o[2]]
        if out:
            yield _run_batch(out)

    def run(batches):
        shard, held, rows = None, 0, []
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("shard", "h", "c", "raw")]
            for s, h, c, raw in zip(*cols):
                if rows and (s != shard or held > most and h != rows[-1][0]):
                    yield from finish(rows)
                    held, rows = 0, []
                shard = s
                held += len(raw)
                rows.append((h, c, raw))
        if rows:
            yield from finish(rows)
    return run


_RUNS = "h long, c long, first array<int>, end array<int>"


def _run_batch(rows):
    h, c, first, end = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(h, pa.int64()), pa.array(c, pa.int64()),
         pa.array(first, pa.list_(pa.int32())), pa.array(end, pa.list_(pa.int32()))], names=["h", "c", "first", "end"])


def _by_sort(contents: DataFrame, length: int) -> DataFrame:
    """``(h, c, first, end)``: repeated windows of contents, by sorted shards."""
    spark = contents.sparkSession
    total, = contents.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    return (contents.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(n)).cast("int"))
            .repartition(n, "shard").sortWithinPartitions("shard", "h", "c")
            .mapInArrow(_sorted_shards(length, HOT_BYTES), _RUNS))


def _by_hash(contents: DataFrame, length: int) -> DataFrame:
    """The same by the windows' hashes: nothing is gathered but counts and, for
    ``WINDOWS`` neighbouring starts of a content, which of them repeat."""
    most = WINDOWS

    def hashes(batches):
        from xxhash import xxh3_128_digest
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("h", "c", "raw")]
            parts, held = [], 0
            for h, c, raw in zip(*cols):
                windows = len(raw) - length + 1
                for lo in range(0, windows, most):
                    hi = min(windows, lo + most)
                    digests = b"".join([xxh3_128_digest(raw[i:i + length]) for i in range(lo, hi)])
                    parts.append((h, c, lo, hi, np.frombuffer(digests, "<i8").reshape(-1, 2)))
                    held += hi - lo
                    if held >= most:
                        yield _hash_batch(parts)
                        parts, held = [], 0
            if parts:
                yield _hash_batch(parts)

    def to_runs(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                s = np.sort(np.array(r["s"], np.int32))
                new = np.flatnonzero(np.diff(s) > 1)
                out.append((r["h"], r["c"], s[np.append(0, new + 1)].tolist(), (s[np.append(new, len(s) - 1)] + 1).tolist()))
            if out:
                yield _run_batch(out)
    windows = contents.select("h", "c", "raw").mapInArrow(hashes, "h long, c long, s int, x long, y long")
    same = windows.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    return (windows.hint("merge").join(same, ["x", "y"])
            .groupBy("h", "c", F.floor(F.col("s") / F.lit(most)).alias("block"))
            .agg(F.collect_list("s").alias("s")).select("h", "c", "s").mapInArrow(to_runs, _RUNS))


def _hash_batch(parts):
    sizes = [hi - lo for _, _, lo, hi, _ in parts]
    xy = np.concatenate([p[4] for p in parts])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array([p[i] for p in parts], np.int64), sizes)) for i in (0, 1)]
        + [pa.array(np.concatenate([np.arange(lo, hi, dtype=np.int32) for _, _, lo, hi, _ in parts]))]
        + [pa.array(np.ascontiguousarray(xy[:, i])) for i in (0, 1)], names=["h", "c", "s", "x", "y"])


def _spread_runs(found: DataFrame) -> DataFrame:
    return found.select("h", "c", F.explode(F.arrays_zip("first", "end")).alias("x")).select("h", "c", "x.first", "x.end")


def _repeated(contents: DataFrame, length: int, anchor: int, seed: int) -> DataFrame:
    """``(h, c, first, end)``: runs of repeated windows within contents ``(h, c, raw)``."""
    hot = written(contents.groupBy("h").agg(F.sum(F.length("raw")).alias("bytes")).where(F.col("bytes") > HOT_BYTES)
                  .select("h"))
    if hot.isEmpty():
        return _spread_runs(_by_sort(contents, length))
    hot = F.broadcast(hot)                                  # at most one row for HOT_BYTES of contents
    cold = _spread_runs(_by_sort(contents.join(hot, "h", "left_anti"), length))
    dense = contents.join(hot, "h")
    if seed + 1 >= ROUNDS:
        return cold.unionByName(_spread_runs(_by_hash(dense, length)))
    dense = written(_keyed(dense.select("h", "c", F.col("raw").alias("text"))))
    again = repeats(dense.select("text"), length, anchor, seed + 1)
    return cold.unionByName(dense.select("h", "c", "t").join(again, "t")
                            .select("h", "c", F.explode("runs").alias("x")).select("h", "c", "x.first", "x.end"))


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, seed: int = 0) -> DataFrame:
    """``(t, first, end)``: per distinct text (by its 128-bit key) the runs of
    starts of repeated windows. ``docs(text)``, as a string or bytes."""
    placed = written(_placed(docs, length, anchor, seed))
    groups = placed.groupBy("h", "c").agg(
        F.sum("m").alias("times"), F.max("twice").alias("twice"), F.min(F.struct("t", "a", "b")).alias("at"))
    kinds = groups.groupBy("h").agg(F.count("*").alias("kinds"))
    groups = written(groups.join(kinds, "h").where("times > 1 or kinds > 1 or twice"))

    want = (groups.where("times = 1 or kinds > 1 or twice")
            .select(F.col("at.t").alias("t"), F.struct("h", "c", "at.a", "at.b").alias("s"))
            .groupBy("t").agg(F.collect_list("s").alias("want")))              # a text's own segments
    keyed = _keyed(docs).join(want.select("t"), "t", "left_semi").dropDuplicates(["t"])
    contents = written(keyed.join(want, "t").select("text", "want")
                       .mapInArrow(_cut_texts(length), "h long, c long, raw binary"))
    copies = groups.where("times > 1").select("h", "c", F.lit(0).alias("first"),
                                              (F.col("at.b") - F.col("at.a") + 1).alias("end"))
    runs = _repeated(contents, length, anchor, seed).unionByName(copies)
    return (placed.select("h", "c", "t", "a").join(runs, ["h", "c"])
            .select("t", (F.col("a") + F.col("first")).alias("first"), (F.col("a") + F.col("end")).alias("end"))
            .groupBy("t").agg(F.collect_set(F.struct("first", "end")).alias("runs")))    # a text's own windows


def _keyed(docs: DataFrame) -> DataFrame:
    def run(batches):
        from xxhash import xxh3_128_digest
        for batch in batches:
            for part, text in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([xxh3_128_digest(_raw(t)) for t in text], pa.binary())],
                    names=[*part.schema.names, "t"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, schema + ", t binary")


def _spans(runs, length: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in sorted((r["first"], r["end"] + length - 1) for r in runs or ()):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append([*r])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, keep_bytes: bool = True,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept, spans])``, one row
    per input row: every byte that lies in a string of ``length`` bytes starting
    at two places of the table is removed.

    ``kept`` holds the remaining bytes (a cut can split a character), ``spans`` the
    removed ``(start, end)`` pairs. A null text is empty; shorter texts keep all.
    Repeated rows are two places. Rows with a null id are handled like any
    other. An empty table gives no rows.
    """
    docs = id_and_text(docs, id_col, text_col)
    found = repeats(docs, length, anchor)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_bytes:
        schema += ", kept binary, spans array<struct<start:long,end:long>>"

    def rebuild(batches):
        for batch in batches:
            cols = [[] for _ in range(7)]
            for r in batch.to_pylist():
                raw = r["text"].encode()
                spans = _spans(r["runs"], length)
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = (r["doc_id"], len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept,
                       [{"start": a, "end": b} for a, b in spans])
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_bytes:
                kinds += [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
    return _keyed(docs).join(found, "t", "left").select("doc_id", "text", "runs").mapInArrow(rebuild, schema)
