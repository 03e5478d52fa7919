"""Sequence samples for the classifier (W8) and latest-window inputs.

W8: for each device, the sample ending at row j takes the feature rows
j-L+1..j and the label at row j+H; a device yields n-L-H+1 samples and
none when n < L+H. Built with ``collect_list`` over a bounded row frame
and ``lead`` — evaluated by :func:`ordered_window`, so a hot device is cut
into blocks with an (L-1)-row halo behind and an H-row halo ahead.

W9: the newest L rows per device (``row_number`` desc <= L, a
WindowGroupLimit that keeps only L rows per device in each map task), then
one ordered ``collect_list`` per device; devices with fewer rows get an
error marker instead of a vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearsight.operators.ordered import DEFAULT_BLOCK_ROWS, ordered_window


def _row_vector(features: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def sequence_samples(df: DataFrame, key: list[str], order: list[str], features: list[str], label: str,
                     length: int, horizon: int, block_rows: int = DEFAULT_BLOCK_ROWS,
                     write_once: bool = False) -> DataFrame:
    """One row per sample: key, end-row order columns, ``seq`` (L*F doubles,
    row-major, oldest first) and ``label`` (the label ``horizon`` rows later)."""
    def build(w):
        fr = w.rowsBetween(-(length - 1), 0)
        return {
            "_xs": F.collect_list(F.struct(F.col("_pos").alias("p"), F.col("_x").alias("x"))).over(fr),
            "_y": F.lead(label, horizon).over(w),
        }

    out = ordered_window(df.withColumn("_x", _row_vector(features)), key, order, build,
                         lookback=length - 1, lookahead=horizon, block_rows=block_rows, write_once=write_once)
    out = out.where((F.col("_pos") >= length - 1) & F.col("_y").isNotNull())
    seq = F.flatten(F.transform(F.array_sort("_xs"), lambda s: s["x"]))
    return out.select(*key, *order, seq.alias("seq"), F.col("_y").alias("label"))


def latest_sequence(df: DataFrame, key: list[str], order: list[str], features: list[str], length: int
                    ) -> DataFrame:
    """Per key the newest ``length`` rows as one row-major vector, oldest
    first; ``n_rows`` tells how many rows exist (< length -> ``seq`` null)."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    last = (df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= length)
              .withColumn("_x", _row_vector(features)))
    g = last.groupBy(*key).agg(
        F.collect_list(F.struct(F.col("_rn").alias("r"), F.col("_x").alias("x"))).alias("_xs"),
        F.max(F.struct(*[F.col(c) for c in order])).alias("_last"),
        F.count(F.lit(1)).alias("n_rows"))
    ordered = F.transform(F.reverse(F.array_sort("_xs")), lambda s: s["x"])
    return g.select(*key, *[F.col(f"_last.{c}").alias(c) for c in order], "n_rows",
                    F.when(F.col("n_rows") >= length, F.flatten(ordered)).alias("seq"))
