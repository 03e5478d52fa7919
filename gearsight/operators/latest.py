"""Latest / last-N rows per device.

``latest_per_device`` is an aggregate (``max_by``), not a window: Spark
combines it map-side, so a device holding a third of all rows costs one
partial row per task before the shuffle.

``last_n_per_device`` uses ``row_number() <= n``; Spark plans this as a
WindowGroupLimit that keeps only n rows per device in each map task before
the shuffle, so the shuffled volume is bounded by n * devices * tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_device(df: DataFrame, device: str = "device_id",
                      order: list[str] | None = None) -> DataFrame:
    """One row per device: the row with the greatest (order...) key."""
    order = order or ["ts"]
    payload = [c for c in df.columns if c != device]
    key = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(device).agg(F.max_by(F.struct(*[F.col(c) for c in payload]), key).alias("_r"))
    return agg.select(device, *[F.col(f"_r.{c}").alias(c) for c in payload])


def last_n_per_device(df: DataFrame, n: int, device: str = "device_id",
                      order: list[str] | None = None, rank_col: str | None = None) -> DataFrame:
    """The newest ``n`` rows per device (by ``order`` descending, unique tiebreak last).

    ``rank_col`` keeps the recency rank (1 = newest) as a column.
    """
    order = order or ["ts"]
    w = Window.partitionBy(device).orderBy(*[F.col(c).desc() for c in order])
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    if rank_col:
        return out.withColumnRenamed("_rn", rank_col)
    return out.drop("_rn")
