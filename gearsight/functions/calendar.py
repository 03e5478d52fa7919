"""Calendar parts and time period (F1, F2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_period(hour: Column, zero_is_night: bool = False) -> Column:
    """(0,6] night, (6,12] morning, (12,18] afternoon, (18,24] evening.

    Hour 0 falls outside every bin (null), as in the reference; set
    ``zero_is_night`` to put it into night instead (Q8).
    """
    night = (hour > 0) & (hour <= 6)
    if zero_is_night:
        night = night | (hour == 0)
    return (F.when(night, F.lit("night"))
            .when((hour > 6) & (hour <= 12), F.lit("morning"))
            .when((hour > 12) & (hour <= 18), F.lit("afternoon"))
            .when((hour > 18) & (hour <= 24), F.lit("evening")))


def add_time_features(df: DataFrame, ts: str = "ts", zero_is_night: bool = False,
                      with_minute: bool = True) -> DataFrame:
    """F1 + F2: hour, minute, day_of_week (Monday 0), month, quarter, is_weekend, time_period."""
    t = F.col(ts)
    cols = {
        "hour": F.hour(t),
        "day_of_week": F.weekday(t),
        "month": F.month(t),
        "quarter": F.quarter(t),
    }
    if with_minute:
        cols["minute"] = F.minute(t)
    out = df.withColumns(cols)
    return out.withColumns({
        "is_weekend": F.when(F.col("day_of_week").isin(5, 6), F.lit(1)).otherwise(F.lit(0)),
        "time_period": time_period(F.col("hour"), zero_is_night),
    })
