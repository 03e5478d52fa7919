"""Removal of lines that many documents share.

1. Each document becomes its list of 128-bit line-key hashes (written once),
   known by a hash of its text: equal texts lose equal lines.
2. The hashes are counted per document with map-side combining.
3. Distinct hashes go to shards of bounded size. A shard builds a minimal
   perfect hash (levels of bit arrays; a key's index is the rank of its bit)
   with a fingerprint and a saturating count at each index.
4. Documents probe: one row per (document, line hash) goes to the hash's shard,
   where the shard's arrays come first in the sort order and are the only thing
   held in memory. Lines are never joined with lines.
5. A hash that holds a 4,096th of all these rows or more would make its shard hot.
   There are 4,096 such hashes at most; their own small index goes to every task
   and is probed where the documents are, so nothing hot is shuffled.
6. Only the hashes to drop go back to the texts.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import Shared, id_and_text, slices, texts, written

SHARD_KEYS = 1 << 18        # distinct hashes per shard: about 1.3 MB of arrays
PROBES = 1 << 20            # mean number of probes per shard
HOT = 1 << 12               # hashes that every task probes: those of at least 1 / HOT of all probes
SPACE = b" \t\n\x0b\x0c\r"
_LEVELS = 24
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def key_hashes(text: str) -> np.ndarray:
    """``(lines, 2)`` unsigned longs: the 128-bit hash of each line's key; both
    zero for an empty key."""
    from xxhash import xxh3_128_digest
    keys = [line_key(x) for x in text.encode().split(b"\n")]
    return np.frombuffer(b"".join(xxh3_128_digest(k) if k else bytes(16) for k in keys), "<u8").reshape(-1, 2)


# --- minimal perfect hash -----------------------------------------------------------------

def _slot(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.uint64((level + 1) * _MIX[0] & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_index(keys: np.ndarray, counts: np.ndarray, most: int, exact: bool = False) -> dict:
    """Index of distinct ``keys`` (n, 2). Keys without a free slot after the last
    level stay in a short sorted list. Counts saturate at ``most``. With ``exact``
    whole keys are kept beside the fingerprints, for probes by keys of other sets."""
    levels, left, order, done = [], np.arange(len(keys)), [], 0
    for level in range(_LEVELS):
        if not len(left):
            break
        size = max(64, int(1.5 * len(left)))
        at = _slot(keys[left, 0], level, size)
        alone = np.bincount(at, minlength=size) == 1
        ok = alone[at]
        ranks = np.cumsum(alone) - 1
        levels.append((np.packbits(alone), done, size))
        order.append((left[ok], ranks[at[ok]] + done))
        done += int(ok.sum())
        left = left[~ok]
    rest = left[np.lexsort((keys[left, 1], keys[left, 0]))]
    order.append((rest, done + np.arange(len(rest))))
    prints, values = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint8 if most < 256 else np.uint32)
    for of, to in order:
        prints[to] = (keys[of, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        values[to] = np.minimum(counts[of], most)
    whole = np.zeros((len(keys), 2), np.uint64) if exact else None
    for of, to in order if exact else ():
        whole[to] = keys[of]
    return {"levels": levels, "rest": keys[rest], "first": done, "prints": prints, "values": values, "whole": whole}


def open_index(index: dict) -> dict:
    """The index with ranks of every bit laid out for probing."""
    return index | {"ranks": [(bits := np.unpackbits(b, count=size).astype(bool), np.cumsum(bits) - 1 + done, size)
                              for b, done, size in index["levels"]]}


def probe(index: dict, h: np.ndarray) -> np.ndarray:
    """Counts of ``h`` (n, 2); zero where the fingerprint (or the whole key) differs."""
    place, left = np.full(len(h), -1), np.arange(len(h))
    for level, (bits, ranks, size) in enumerate(index["ranks"]):
        if not len(left):
            break
        at = _slot(h[left, 0], level, size)
        hit = bits[at]
        place[left[hit]] = ranks[at[hit]]
        left = left[~hit]
    if len(left) and len(index["rest"]):
        where = {tuple(k): i for i, k in enumerate(index["rest"].tolist())}
        for i in left.tolist():
            place[i] = index["first"] + where.get(tuple(h[i].tolist()), -1 - index["first"])
    ok = place >= 0
    out = np.zeros(len(h), np.int64)
    if index["whole"] is not None:
        same = (index["whole"][place[ok]] == h[ok]).all(axis=1)
    else:
        same = index["prints"][place[ok]] == (h[ok, 1] & np.uint64(0xFFFF)).astype(np.uint16)
    out[ok] = np.where(same, index["values"][place[ok]], 0)
    return out


# --- the Spark job ------------------------------------------------------------------------

def _by_text(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_line_key``, the MD5 of the text: what a document loses follows from its text."""
    return docs.withColumn("_line_key", F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))


def _hash_lists(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, text in slices(batch):
                yield pa.record_batch([part.column(0), pa.array([key_hashes(t).tobytes() for t in text], pa.binary())],
                                      names=["key", "hashes"])
    return docs.mapInArrow(run, "key binary, hashes binary")


def _distinct(blob: bytes) -> np.ndarray:
    """A document's different keys; empty lines have none."""
    h = np.unique(np.frombuffer(blob, "<u8").reshape(-1, 2), axis=0)
    return h[(h != 0).any(axis=1)]


def _counted(lists: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, blobs in slices(batch, "hashes", 4096):
                h = np.concatenate([_distinct(b) for b in blobs])
                if len(h):
                    keys, n = np.unique(h, axis=0, return_counts=True)
                    yield pa.record_batch([pa.array(np.ascontiguousarray(keys[:, i]).view(np.int64)) for i in (0, 1)]
                                          + [pa.array(n)], names=["h0", "h1", "n"])
    return (lists.select("hashes").mapInArrow(run, "h0 long, h1 long, n long")
            .groupBy("h0", "h1").agg(F.sum("n").alias("n")))


def _indexes(counts: DataFrame, shards: int, most: int) -> DataFrame:
    def build(pdf):
        keys = pdf[["h0", "h1"]].to_numpy(np.int64).view(np.uint64)
        index = build_index(keys, pdf["n"].to_numpy(), most)
        return pdf.iloc[:1][["shard"]].assign(arrays=pickle.dumps(index))
    return (counts.withColumn("shard", F.pmod(F.col("h0"), F.lit(shards)).cast("int"))
            .groupBy("shard").applyInPandas(build, "shard int, arrays binary"))


def _probes(lists: DataFrame, hot: Shared) -> DataFrame:
    """``(key, h0, h1)``: every document with each of its different hashes that is not hot."""
    def run(batches):
        index = hot.value
        for batch in batches:
            for part, blobs in slices(batch, "hashes", 1024):
                each = [_distinct(b) for b in blobs]
                h = np.concatenate(each)
                of = np.repeat(np.arange(len(each)), [len(x) for x in each])
                cold = probe(index, h) == 0
                if cold.any():
                    h = np.ascontiguousarray(h[cold].T).view(np.int64)
                    yield pa.record_batch([part.column(0).take(pa.array(of[cold])), pa.array(h[0]), pa.array(h[1])],
                                          names=["key", "h0", "h1"])
    return lists.mapInArrow(run, "key binary, h0 long, h1 long")


def _answers(probes: DataFrame, indexes: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """``(key, gone)``: for each text the hashes that ``min_docs`` documents hold."""
    nothing = F.lit(None)
    both = (indexes.select("shard", F.lit(0).alias("kind"), nothing.cast("binary").alias("key"), nothing.cast("long").alias("h0"),
                           nothing.cast("long").alias("h1"), "arrays")
            .unionByName(probes.withColumns({"shard": F.pmod(F.col("h0"), F.lit(shards)).cast("int"), "kind": F.lit(1),
                                             "arrays": nothing.cast("binary")})))

    def run(batches):
        index, at = None, None
        for batch in batches:
            shard, kind = (batch.column(i).to_numpy() for i in (0, 1))
            h = np.column_stack([batch.column(i).fill_null(0).to_numpy().view(np.uint64) for i in (3, 4)])
            gone = np.zeros(len(shard), bool)
            edges = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1)).tolist() + [len(shard)]
            for a, b in zip(edges, edges[1:]):
                if kind[a] == 0:
                    index, at = open_index(pickle.loads(batch.column(5)[a].as_py())), shard[a]
                    a += 1
                assert at == shard[b - 1], "a shard's arrays come before its probes"
                gone[a:b] = probe(index, h[a:b]) >= min_docs
            yield pa.record_batch([batch.column(i).filter(pa.array(gone)) for i in (2, 3, 4)], names=["key", "h0", "h1"])
    n = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (both.repartition(max(n, shards // 4), "shard").sortWithinPartitions("shard", "kind")
            .mapInArrow(run, "key binary, h0 long, h1 long")
            .groupBy("key").agg(F.collect_set(F.struct("h0", "h1")).alias("gone")))


def _gone(docs: DataFrame, min_docs: int) -> tuple[DataFrame, Shared]:
    """``(key, gone)`` of ``docs(key, text)``, and the index of the hot hashes."""
    spark = docs.sparkSession
    lists = written(_hash_lists(docs))
    counts = written(_counted(lists))
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = counts.where(F.col("n") * HOT >= total).toPandas()
    keys = np.ascontiguousarray(hot[["h0", "h1"]].to_numpy(np.int64)).view(np.uint64)
    shared = Shared(spark, open_index(build_index(keys, hot["n"].to_numpy(np.int64), max(min_docs, 1), exact=True)))
    shards = max(-(-n // SHARD_KEYS), -(-total // PROBES), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return written(_answers(_probes(lists, shared), _indexes(counts, shards, min_docs), shards, min_docs)), shared


def _kept_lines(text: str, gone, hot: dict, min_docs: int) -> tuple[str, int, int]:
    """The text without the lines whose key hash is in ``gone`` or hot and common; its
    lines before, and the dropped ones."""
    lines, h = text.encode().split(b"\n"), key_hashes(text)
    bad = (probe(hot, h) >= min_docs) & (h != 0).any(axis=1)
    if gone:
        own = {(g["h0"], g["h1"]) for g in gone}
        bad |= np.fromiter((k in own for k in map(tuple, h.view(np.int64).tolist())), bool, len(h))
    if not bad.any():
        return text, len(lines), 0
    return b"\n".join([x for x, b in zip(lines, bad.tolist()) if not b]).decode(), len(lines), int(bad.sum())


def drop_common_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``(doc_id, text, n_lines, n_dropped)``: one row per input row, its text
    without the lines whose key at least ``min_docs`` rows hold.

    A key is the line without surrounding ASCII white space, A-Z lower-cased;
    empty keys are never dropped. A null text is one empty line. Each row is a
    document: a repeated row counts again. Ids play no part: rows with null or
    equal ids are handled like any other. An empty table gives no rows.
    """
    docs = _by_text(id_and_text(docs, id_col, text_col), "text")
    found, hot = _gone(docs.select("_line_key", "text"), min_docs)

    def rebuild(batches):
        index = hot.value
        for batch in batches:
            for part, text in slices(batch):
                out = [_kept_lines(t, gone, index, min_docs) for t, gone in zip(text, texts(part, "gone"))]
                yield pa.record_batch(
                    [part.column(part.schema.get_field_index("doc_id")), pa.array([o[0] for o in out], pa.string()),
                     pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())],
                    names=["doc_id", "text", "n_lines", "n_dropped"])
    # a shuffle join at every size, as what goes follows the documents
    return (docs.hint("merge").join(found.withColumnRenamed("key", "_line_key"), "_line_key", "left").select("doc_id", "text", "gone")
            .mapInArrow(rebuild, "doc_id long, text string, n_lines long, n_dropped long"))


def without_common_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and rows, texts as in :func:`drop_common_lines`
    (a null text becomes the empty text)."""
    schema, at = docs.schema, docs.columns.index(text_col)
    keyed = _by_text(docs, text_col)
    found, hot = _gone(_by_text(id_and_text(docs, id_col, text_col), "text").select("_line_key", "text"), min_docs)
    found = found.select(F.col("key").alias("_line_key"), F.col("gone").alias("_line_gone"))

    def rebuild(batches):
        index = hot.value
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                cols = list(part.columns)
                cols[at] = pa.array([_kept_lines(t or "", gone, index, min_docs)[0] for t, gone in
                                     zip(cols[at].to_pylist(), cols.pop().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names[:-1])
    joined = keyed.hint("merge").join(found, "_line_key", "left").select(*[keyed[c] for c in docs.columns], "_line_gone")
    return joined.mapInArrow(rebuild, schema)
