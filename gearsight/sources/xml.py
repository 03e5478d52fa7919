"""Tag-history XML scan (S1-S3, S12) and its clean-up.

Spark's XML source reads every ``HistoricalTextData`` element at any depth
as one row. All four children are read as STRING so a bad number never
marks a record corrupt; the rules are then column expressions:

* all four children present (missing child = NULL, empty child = '');
* empty child -> default ('' for text, 0 for status, 0.0 for value); a child of
  white space alone is not empty and is no number;
* a status that is not an integer or a value that is not a number drops
  the record; tag and timestamp are trimmed.

A file that is not well-formed yields a ``_corrupt_record`` row; such a
file contributes nothing (S2): the few paths with such a row are aggregated
and anti-joined, so the rows themselves are not shuffled by file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.config import ROBOT_TAG_MAP

# Texts that are numbers: no suffixes such as 1f or 1.0d.
INTEGER = r"^[+-]?\d+$"
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"
RAW_SCHEMA = "TagName string, Status string, TagValue string, TimeStamp string, _corrupt_record string"


def list_files(spark: SparkSession, pattern: str, max_files: int | None = None) -> list[str]:
    """S3: the files matching a glob, sorted by path, capped at ``max_files`` (Q1:
    sort first, then cap). Only paths (metadata) reach the driver."""
    files = (spark.read.format("binaryFile").load(pattern).select("path").distinct()
             .orderBy("path"))
    if max_files:
        files = files.limit(max_files)
    return [r.path for r in files.collect()]


def newest_file(spark: SparkSession, pattern: str) -> str | None:
    """Path of the most recently modified file matching the glob."""
    r = (spark.read.format("binaryFile").load(pattern)
         .select("path", "modificationTime")
         .orderBy(F.col("modificationTime").desc(), F.col("path").desc()).limit(1).collect())
    return r[0].path if r else None


def read_tag_history(spark: SparkSession, paths: str | list[str], row_tag: str = "HistoricalTextData",
                     partitions: str | None = None, extra: str | None = None) -> DataFrame:
    """S1 + S2 + S3: tag_name, status, tag_value, timestamp (string), file_source.

    ``partitions`` names a partition column of a partitioned folder (e.g. a
    device id) to keep, ``extra`` a further child of the records; a record may lack it."""
    kept = [c for c in (partitions, extra) if c]
    raw = (spark.read.format("xml").option("rowTag", row_tag)
           .option("columnNameOfCorruptRecord", "_corrupt_record")
           .option("mode", "PERMISSIVE").option("ignoreSurroundingSpaces", "false")
           .schema(RAW_SCHEMA + "".join(f", {c} string" for c in kept))
           .load(paths)
           .select("*", F.col("_metadata.file_path").alias("_path"),
                   F.col("_metadata.file_name").alias("file_source")))
    # the tag count is there because Spark refuses to read the corrupt column alone
    bad = (raw.groupBy("_path").agg(F.count("_corrupt_record").alias("_bad"), F.count("TagName").alias("_tags"))
           .where("_bad > 0 and _tags >= 0").select("_path"))
    good = raw.join(bad, "_path", "left_anti")
    present = (F.col("TagName").isNotNull() & F.col("Status").isNotNull()
               & F.col("TagValue").isNotNull() & F.col("TimeStamp").isNotNull())
    status = F.when(F.col("Status") == "", F.lit(0)).when(
        F.trim("Status").rlike(INTEGER), F.expr("try_cast(trim(Status) AS INT)"))
    value = F.when(F.col("TagValue") == "", F.lit(0.0)).when(
        F.trim("TagValue").rlike(NUMBER), F.expr("try_cast(trim(TagValue) AS DOUBLE)"))
    rec = good.where(present).select(
        F.trim("TagName").alias("tag_name"), status.alias("status"), value.alias("tag_value"),
        F.trim("TimeStamp").alias("timestamp"), "file_source", *kept)
    return rec.where(F.col("status").isNotNull() & F.col("tag_value").isNotNull())


def tag_map_frame(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    """The tag map as a DataFrame (29 rows by default)."""
    mapping = ROBOT_TAG_MAP if mapping is None else mapping
    return spark.createDataFrame(sorted(mapping.items()), "tag_name string, sensor_name string")


def clean_tag_history(records: DataFrame, tag_map: DataFrame, good_status: int = 0) -> DataFrame:
    """P4 + J1 + P5: parse time (unparsable dropped), keep mapped tags, keep
    good-quality rows. The tag map is a fixed configuration table (tens of
    rows), so it is broadcast."""
    ts = F.expr("try_to_timestamp(timestamp)").cast("timestamp_ntz")
    parsed = records.withColumn("ts", ts).where(F.col("ts").isNotNull())
    mapped = parsed.join(F.broadcast(tag_map), "tag_name", "inner")
    return mapped.where(F.col("status") == good_status)


def unmapped_tags(records: DataFrame, tag_map: DataFrame, k: int = 10) -> DataFrame:
    """J1 report: the k most frequent tags the map does not know."""
    return (records.join(F.broadcast(tag_map.select("tag_name")), "tag_name", "left_anti")
                   .groupBy("tag_name").agg(F.count(F.lit(1)).alias("n"))
                   .orderBy(F.col("n").desc(), "tag_name").limit(k))


def tag_profile(records: DataFrame, tag: str = "tag_name", order: list[str] | None = None,
                k: int = 20) -> DataFrame:
    """Count per tag with the first sample (value, timestamp, status) by
    ``order``; top k by count. One aggregate with ``min_by``."""
    order = order or ["file_source", "timestamp"]
    first = F.min_by(F.struct("tag_value", "timestamp", "status"), F.struct(*order))
    return (records.groupBy(tag).agg(F.count(F.lit(1)).alias("n"), first.alias("_s"))
                   .select(tag, "n", F.col("_s.tag_value").alias("sample_value"),
                           F.col("_s.timestamp").alias("sample_timestamp"),
                           F.col("_s.status").alias("sample_status"))
                   .orderBy(F.col("n").desc(), tag).limit(k))


def tag_pattern_groups(records: DataFrame, patterns: tuple[str, ...], tag: str = "tag_name") -> DataFrame:
    """(pattern, tag) for every distinct tag containing the pattern,
    case-insensitive; a tag can fall in several groups."""
    tags = records.select(tag).distinct()
    arr = F.array(*[F.lit(p) for p in patterns])
    return tags.select(F.explode(F.filter(arr, lambda p: F.lower(F.col(tag)).contains(p))).alias("pattern"),
                       tag)


def write_tag_history(records: DataFrame, path: str, partition: str | None = None) -> None:
    """Write (TagName, Status, TagValue, TimeStamp) rows as tag-history XML,
    one ``HistoricalTextData`` element per row, in parallel part files."""
    w = records.write.mode("overwrite").format("xml").option("rowTag", "HistoricalTextData") \
        .option("rootTag", "root")
    (w.partitionBy(partition) if partition else w).save(path)
