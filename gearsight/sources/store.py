"""Reading store on Parquet (S4-S11, A15) and CSV interchange.

Layout: ``<root>/bucket=<b>/day=<yyyy-mm-dd>/part-*.parquet`` with
b = pmod(xxhash64(device_id), buckets). A device's rows live in one bucket,
so a device lookup prunes to one bucket directory; the day level prunes
time ranges. Sensors are a MAP<STRING,DOUBLE> column (JSON only at the CSV
edge, P2/P3). Rows are never collected: every operation is a scan, an
aggregate, or a partition rewrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.operators.latest import last_n_per_device
from gearsight.session import checkpoint_dir

STORE_COLUMNS = ["device_id", "ts", "operating_hours", "health_score", "anomaly_score", "status", "sensors"]


def bucket_of(device: F.Column, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(device), F.lit(buckets)).cast("int")


class ReadingStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # ---- S7
    def append(self, readings: DataFrame) -> None:
        """Append readings (STORE_COLUMNS); new files only, nothing rewritten. Rows
        are rebalanced by (bucket, day): small ones share a writer, a hot one
        is split over several."""
        rows = readings.select(*STORE_COLUMNS).withColumns({
            "bucket": bucket_of(F.col("device_id"), self.buckets),
            "day": F.to_date("ts")})
        (rows.hint("rebalance", "bucket", "day").write.mode("append")
             .partitionBy("bucket", "day").parquet(self.root))

    def _scan(self) -> DataFrame:
        return self.spark.read.parquet(self.root)

    def _device(self, device_id: str) -> DataFrame:
        b = self.spark.range(1).select(bucket_of(F.lit(device_id), self.buckets)).first()[0]
        return self._scan().where((F.col("bucket") == b) & (F.col("device_id") == device_id))

    # ---- S5 / S6 / W10 / P1
    def device_data(self, device_id: str, count: int = 100, sensors: list[str] | None = None) -> DataFrame:
        """Newest ``count`` readings of one device (bucket-pruned), oldest first
        (O1: the only sort is at the output), sensors flattened to columns when
        ``sensors`` is given."""
        d = last_n_per_device(self._device(device_id), count, "device_id", ["ts"])
        d = d.drop("bucket", "day").orderBy("ts")
        if sensors:
            d = d.select(*[c for c in d.columns if c != "sensors"],
                         *[F.col("sensors")[s].alias(s) for s in sensors])
        return d

    # ---- S9
    def devices(self) -> DataFrame:
        return self._scan().select("device_id").distinct()

    # ---- S10
    def all_data(self) -> DataFrame:
        return self._scan().drop("bucket", "day")

    def export_csv(self, path: str, sensors: list[str]) -> None:
        """Concatenate all devices and write CSV (a directory of part files)."""
        d = self.all_data()
        flat = d.select("device_id", F.col("ts").cast("string").alias("timestamp"), "operating_hours",
                        "health_score", "anomaly_score", "status",
                        *[F.col("sensors")[s].alias(s) for s in sensors])
        flat.write.mode("overwrite").option("header", True).csv(path)

    # ---- S8
    def delete_devices(self, devices: DataFrame) -> DataFrame:
        """Drop the rows of ``devices(device_id)``; returns ``(device_id, removed)``,
        zero for devices that had none.

        Only the (bucket, day) partitions that hold such rows are rewritten, by
        one dynamic overwrite. The kept rows and the counts are checkpointed
        first (shared folder), because partitions are read and replaced in one
        go; partitions left without rows are removed after the overwrite. Run it
        again after a failure: it removes what is left.
        """
        checkpoint_dir(self.spark)
        gone = devices.select("device_id").where("device_id is not null").distinct()
        named = gone.withColumn("bucket", bucket_of(F.col("device_id"), self.buckets))
        scan = self._scan()
        hits = scan.join(named, ["bucket", "device_id"], "left_semi")
        counts = gone.join(hits.groupBy("device_id").agg(F.count(F.lit(1)).alias("removed")), "device_id", "left") \
            .select("device_id", F.coalesce("removed", F.lit(0)).cast("long").alias("removed")).checkpoint(eager=True)
        touched = hits.select("bucket", "day").distinct().checkpoint(eager=True)
        keep = (scan.join(touched, ["bucket", "day"], "left_semi").join(gone, "device_id", "left_anti")
                .checkpoint(eager=True))
        (keep.hint("rebalance", "bucket", "day").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "day").parquet(self.root))
        # partitions left empty are not touched by a dynamic overwrite: remove them
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        empty = touched.join(keep.select("bucket", "day").distinct(), ["bucket", "day"], "left_anti")
        for r in empty.toLocalIterator():       # at most buckets x days folder names
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/bucket={r['bucket']}/day={r['day']}")
            p.getFileSystem(conf).delete(p, True)
        return counts

    def delete_device(self, device_id: str) -> int:
        """Drop one device's rows; returns their number."""
        one = self.spark.createDataFrame([(device_id,)], "device_id string")
        return self.delete_devices(one).first()["removed"]

    # ---- A15
    def statistics(self) -> DataFrame:
        return store_statistics(self._scan())


def store_statistics(scan: DataFrame, ts: str = "ts", device: str = "device_id") -> DataFrame:
    """Rows, devices, oldest, newest and bytes on disk (sum of distinct
    file sizes from ``_metadata``) — two aggregates, one row."""
    base = scan.select(device, ts, F.col("_metadata.file_path").alias("_f"),
                       F.col("_metadata.file_size").alias("_s"))
    stats = base.agg(F.count(F.lit(1)).alias("total_records"), F.countDistinct(device).alias("devices"),
                     F.min(ts).alias("oldest"), F.max(ts).alias("newest"))
    size = base.groupBy("_f").agg(F.first("_s").alias("_s")).agg(F.sum("_s").alias("size_bytes"))
    return stats.withColumn("_one", F.lit(1)).join(F.broadcast(size.withColumn("_one", F.lit(1))), "_one") \
                .drop("_one")


def _csv_readings(raw: DataFrame, sensors: list[str]) -> DataFrame:
    have = set(raw.columns)

    def text(c: str):
        return F.col(f"`{c}`") if c in have else F.lit(None).cast("string")

    def num(c: str):
        return text(c).try_cast("double")
    return raw.select(
        text("device_id").alias("device_id"),
        F.try_to_timestamp(text("timestamp")).cast("timestamp_ntz").alias("ts"),
        num("operating_hours").alias("operating_hours"), num("health_score").alias("health_score"),
        num("anomaly_score").alias("anomaly_score"), text("status").alias("status"),
        F.map_filter(F.map_from_arrays(F.array(*[F.lit(s) for s in sensors]),
                                       F.array(*[num(s) for s in sensors])),
                     lambda k, v: v.isNotNull()).alias("sensors"))


def read_csv_readings(spark: SparkSession, path: str, sensors: list[str]) -> DataFrame:
    """CSV readings, typed by name (no inference pass). Every file has its own
    header: files are read in groups of equal headers and combined by column
    name. Cells that are no number or time become null; a sensor that a file
    does not have is not in the reading's map."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("f"),
                                         F.col("_metadata.file_block_start").alias("at"))
    # the first line of each file; the driver gets file names by header
    heads = (lines.where("at = 0").withColumn("n", F.monotonically_increasing_id())
             .groupBy("f").agg(F.min_by("value", "n").alias("head"))
             .groupBy("head").agg(F.collect_list("f").alias("files")).collect())
    parts = [_csv_readings(spark.read.option("header", True).option("enforceSchema", False).csv(r["files"]), sensors)
             for r in sorted(heads, key=lambda r: r["head"])]
    if not parts:
        raise ValueError(f"no CSV file with a header in {path}")
    return concat_frames(parts)


def save_processed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S11."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def concat_frames(frames: list[DataFrame]) -> DataFrame:
    """Concatenate frames by column name; a column missing in one frame is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
