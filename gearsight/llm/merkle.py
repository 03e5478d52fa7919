"""Merkle manifest of a dataset: one root over all rows, a proof for each row.

A digest is the lowercase hex SHA-256 of its inputs put together. A group's
leaves ascend by an order; while a group has several nodes, every ``fanout``
consecutive ones become a parent. The groups' roots, ordered by group, are the
leaves of one more tree of the same form.

* Numbering. Leaves are dealt into ranges of (group, order), written, and counted
  per range; a running sum of these counts gives each range its first position.
  Equal leaves can fall into several ranges, so no group and no row repeated many
  times ends in one task.
* Slot pivot. ``groupBy(parent)`` with one conditional aggregate per slot spreads
  a parent's children into ``fanout`` columns; their concatenation is hashed.
* Proofs. From the top down, each parent's row hands every child the slot columns
  before and behind its own (the siblings) in front of the parent's own path, so
  rows move once up and once down, and a path is only joined to parents.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearsight.llm.common import written

FANOUT = 8
TASK_ROWS = 1 << 17     # nodes that one task of an upper level writes
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(column: Column) -> Column:
    """A field's text in a leaf: ``-`` for null, else its UTF-8 byte count, ``:``
    and the value, so no two rows of different values read alike."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*map(field, fields))


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to through the siblings of ``path``."""
    return F.aggregate(path, start, lambda node, run: digest(run["before"], node, run["after"]))


def proof(path: Column) -> Column:
    """All siblings of ``path``, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["before"], run["after"])), "")


def _numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves(group, leaf, row, *order)`` with ``pos`` from 0 in the group and the
    group's number of leaves ``n``."""
    ways = ["group", *order, "leaf", "_tie"]
    spread = written(leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*ways)
                     .withColumn("_range", F.spark_partition_id()))
    group = Window.partitionBy("group")
    counts = (spread.groupBy("group", "_range").count()
              .select("group", "_range", (F.sum("count").over(group.orderBy("_range")) - F.col("count")).alias("_first"),
                      F.sum("count").over(group).alias("n")))
    inside = F.row_number().over(Window.partitionBy("group", "_range").orderBy(*ways[1:])) - 1
    return (spread.withColumn("_in", inside).join(counts, ["group", "_range"])
            .select("group", (F.col("_first") + F.col("_in")).alias("pos"), "n", "leaf", "row"))


def _pivot(nodes: DataFrame, fanout: int, carried: list[str]) -> DataFrame:
    """A row for each run of ``fanout`` nodes: its parent's ``pos`` and ``node``, the
    children's digests ``leaf0..`` and whatever else they carry; ``n`` still counts children."""
    slot = F.col("pos") % fanout
    columns = [F.max(F.when(slot == i, F.col(c))).alias(f"{c}{i}") for i in range(fanout) for c in ["leaf", *carried]]
    runs = (nodes.withColumn("up", F.floor(F.col("pos") / fanout)).groupBy("group", "up")
            .agg(F.max("n").alias("n"), *columns).withColumnRenamed("up", "pos"))
    whole = digest(*[F.coalesce(F.col(f"leaf{i}"), F.lit("")) for i in range(fanout)])
    return runs.withColumn("node", F.when(F.col("n") == 1, F.col("leaf0")).otherwise(whole))


def _levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The runs of every level, leaves first, each written once, in files of some size."""
    levels = [written(_pivot(nodes, fanout, ["row"]))]
    while (size := levels[-1].agg(F.max("n"), F.count("*")).first())[0] and size[0] > fanout:
        up = levels[-1].where(F.col("n") > fanout).select(
            "group", "pos", F.ceil(F.col("n") / fanout).alias("n"), F.col("node").alias("leaf"))
        levels.append(written(_pivot(up, fanout, []).coalesce(-(-size[1] // TASK_ROWS))))
    return levels


def _tops(levels: list[DataFrame], fanout: int) -> DataFrame:
    """``(level, group, top)``: where each group's tree ends, and its root."""
    ends = [runs.where(F.col("n") <= fanout).select(F.lit(k).alias("level"), "group", F.col("node").alias("top"))
            for k, runs in enumerate(levels)]
    return reduce(DataFrame.unionByName, ends)


def _children(runs: DataFrame, above: DataFrame, fanout: int, carried: list[str]) -> DataFrame:
    """``(group, pos, leaf, top, root, path, *carried)`` of the children of ``runs`` from that of the runs."""
    slots = [F.coalesce(F.col(f"leaf{i}"), F.lit("")) for i in range(fanout)]
    children = []
    for i in range(fanout):
        side = F.struct(F.concat(F.lit(""), *slots[:i]).alias("before"), F.concat(F.lit(""), *slots[i + 1:]).alias("after"))
        children.append(F.struct((F.col("pos") * fanout + i).alias("pos"), F.col(f"leaf{i}").alias("leaf"),
                                 side.alias("side"), *[F.col(f"{c}{i}").alias(c) for c in carried]))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array("c.side"), F.col("path")))
    return (runs.join(above, ["group", "pos"]).withColumn("c", F.explode(F.array(*children))).where("c.leaf is not null")
            .select("group", "c.pos", "c.leaf", "top", "root", path.alias("path"), *[f"c.{c}" for c in carried]))


def _down(levels: list[DataFrame], ends: DataFrame, fanout: int) -> DataFrame:
    """``(leaf, row, top, root, path)`` of all leaves; ``ends(level, group, top, root,
    path)`` says what lies above each group's tree."""
    below = None
    for k in reversed(range(len(levels))):
        above = ends.where(F.col("level") == k).select("group", F.lit(0).cast("long").alias("pos"), "top", "root", "path")
        if below is not None:
            above = above.unionByName(below.drop("leaf"))
        below = _children(levels[k], above, fanout, [] if k else ["row"])
    return below.select("leaf", "row", "top", "root", "path")


def manifest(leaves: DataFrame, order: list[str], group: str, fanout: int = FANOUT) -> DataFrame:
    """Each row of ``leaves`` with ``subroot`` (of its group), ``root`` (of all) and
    ``path``, the siblings up to the root: ``leaves`` needs the columns ``leaf`` (a
    digest), ``group``'s and ``order``'s; all columns come back.

    A null group is a group like any other and comes first; groups and strings in
    the order compare by UTF-8 bytes, nulls come first. Leaves of equal order are
    ordered by their digest; equal leaves of equal order are alike, and each has a
    place of its own. A lone leaf is its group's root, a lone group's root the
    root of all; no siblings are added there. No rows give no rows.
    """
    own = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))    # null sorts before "="
    rest = [c for c in leaves.columns if c != "leaf"]
    keys = [f"_order{i}" for i in range(len(order))]
    rows = leaves.select(own.alias("group"), "leaf", F.struct(*rest).alias("row"),
                         *[F.col(c).alias(k) for c, k in zip(order, keys)])
    inner = _levels(_numbered(written(rows), keys), fanout)      # ranges are sought by a pass of its own
    tops = written(_tops(inner, fanout))
    over = tops.select(F.lit("").alias("group"), F.col("top").alias("leaf"), F.struct(*tops.columns).alias("row"),
                       F.col("group").alias("_order0"))
    outer = _levels(_numbered(over, ["_order0"]), fanout)
    ends = _tops(outer, fanout).select("level", "group", "top", F.col("top").alias("root"), F.array().cast(PATH).alias("path"))
    found = _down(outer, ends, fanout).select("row.level", "row.group", "row.top", "root", "path")
    return _down(inner, found, fanout).select(*[f"row.{c}" for c in rest], "leaf", F.col("top").alias("subroot"), "root", "path")
