"""The corpus pipeline: toxicity, common lines, near duplicates, benchmark
leaks, packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.llm import decontam, line_dedup, packing, simhash, toxicity
from gearsight.llm.common import table
from gearsight.llm.queries import tokenizer_path
from gearsight.session import apply_defaults, checkpoint_dir


ROW = "__pipeline_row"


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for each row, written, so both reads see the same keys.
    Ids may be null, repeated or shared by different texts; decisions are by row.
    The texts are written again for this, so as small as Parquet makes them."""
    keyed = docs.withColumn(ROW, F.monotonically_increasing_id())
    path = f"{checkpoint_dir(docs.sparkSession)}/pipeline-rows-{uuid.uuid4().hex}"
    keyed.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(keyed.schema).parquet(path)


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` without those of ``gone(doc_id)``, which names row keys. A shuffle
    join at every size, as ``gone`` grows with the documents."""
    return rows.hint("merge").join(gone.select(F.col("doc_id").alias(ROW)), ROW, "left_anti").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity, learned from all labels outside the held-out fold. A null text stays."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.is_toxic(spark, lexicon, F.col("text")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents hold go. Documents stay, even if empty;
    ``n_chars`` follows the text, and a null text becomes the empty text."""
    return line_dedup.without_common_lines(docs, min_docs=10).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: its first row in the table. Empty
    texts are one group; ids play no part."""
    rows = _rows(docs)
    groups = simhash.near_duplicates(rows, shingle=3, distance=2, id_col=ROW)
    return _without(rows, groups.where("doc_id <> component_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go, each row by its own text."""
    rows = _rows(docs)
    found = decontam.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=ROW)
    return _without(rows, found.select("doc_id").distinct())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is a document of its own; an empty text is one end token."""
    return packing.pack(docs, tokenizer_path(), cap=1024, end_id=2)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", drop_near_duplicates),
          ("decontamination", drop_leaks), ("packing", pack)]

# Learned scores, XXH64 fingerprints and token ids are beyond SQL; tests hold
# each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep. Null and repeated ids, repeated
    rows and an empty table are handled as the stages say; no documents give no rows."""
    apply_defaults(spark)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
