"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pickle
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back, so
    later branches neither recompute it nor depend on executor-local state."""
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; a null text
    becomes the empty text. Any other columns cannot clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def fold(of: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(of.cast("string"), F.lit(""))) % F.lit(mod)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so tables built
    by one task serve the next task of the same worker."""
    holder = sys.modules.setdefault("_gearsight_worker", types.ModuleType("_gearsight_worker"))
    return holder.__dict__.setdefault(name, {})


class Shared:
    """An object sent once to each worker. Its classes travel with it, so workers
    need no copy of this package."""

    def __init__(self, spark: SparkSession, value):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._key = uuid.uuid4().hex

    @property
    def value(self):
        cache = worker_cache("shared")
        if self._key not in cache:
            if len(cache) >= 4:
                cache.clear()
            cache[self._key] = pickle.loads(self._bytes.value)
        return cache[self._key]


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 256):
    """A large batch in pieces, so Python objects of few rows live at once."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, texts(part, column)


def pieces(batch: pa.RecordBatch, column: str, size: int):
    """A batch in runs of rows with about ``size`` bytes in ``column``; a larger
    value is a run of its own."""
    lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0)
    run = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield (part := batch.slice(a, b - a)), texts(part, column)


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by one space; of the whole
    sequence if it is shorter; none for no words."""
    from xxhash import xxh64_intdigest as digest
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - size + 1)
