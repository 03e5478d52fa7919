"""SimHash near-duplicate groups.

Fingerprint: 64 majority bits over the XXH64 values of a text's word shingles.
Two fingerprints link at ``distance`` or fewer differing bits. They are cut in
``distance + 3`` blocks, so a close pair agrees on at least three of them:
every choice of three blocks is a join key (38 or more bits for distance 2).

A key that many different fingerprints share is not joined with itself.
Within such a bucket only the bits outside the key can differ, so each member
is listed once under each choice of ``distance`` of those bits with them
masked out: close pairs share such a masked value, and at most ``2**distance``
fingerprints have the same one. That finds the same links in linear work.

Exact copies meet in one row per fingerprint before any pairing.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import id_and_text, shingle_hashes, slices, written
from gearsight.llm.components import components

BITS = 64
SHARED_BLOCKS = 3
DENSE_BUCKET = 256      # members from which a bucket is searched by masks; any value gives the same links


def fingerprint(text: str, shingle: int) -> int:
    """Unsigned 64-bit fingerprint; zero for a text without words."""
    hashes = shingle_hashes(text.encode().lower().split(), shingle)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, one row per input row; ``fp`` holds the unsigned bits."""
    def run(batches):
        for batch in batches:
            for part, text in slices(batch):
                fp = np.array([fingerprint(t, shingle) for t in text], np.uint64).view(np.int64)
                yield pa.record_batch([part.column(0), pa.array(fp)], names=["doc_id", "fp"])
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _block_masks(distance: int) -> list[int]:
    n = distance + SHARED_BLOCKS
    edges = [round(i * BITS / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, SHARED_BLOCKS)]


def links(fps: DataFrame, distance: int) -> DataFrame:
    """``fps(fp, rep)`` with distinct fingerprints -> ``(a, b)`` pairs of ``rep``
    whose links span the same components as all pairs within ``distance``."""
    masks = _block_masks(distance)
    keyed = fps.select("fp", "rep", F.explode(F.array(*[
        F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("m"))
        for i, m in enumerate(masks)])).alias("key")).select("fp", "rep", "key.k", "key.m")
    sizes = keyed.groupBy("k", "m").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["k", "m"]))

    sparse = shared.where(F.col("n") < DENSE_BUCKET)
    left = sparse.select("k", "m", F.col("fp").alias("x"), F.col("rep").alias("a"))
    right = sparse.select("k", "m", F.col("fp").alias("y"), F.col("rep").alias("b"))
    pairs = (left.join(right, ["k", "m"])
             .where((F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance))
             .select("a", "b"))

    free = [[sum(1 << b for b in c) for c in combinations(
        [b for b in range(BITS) if not m >> b & 1], distance)] for m in masks]
    wild = F.expr("array(%s)" % ",".join("array(%s)" % ",".join(f"{_signed(w)}L" for w in ws) for ws in free))
    masked = (shared.where(F.col("n") >= DENSE_BUCKET)
              .select("k", "fp", "rep", F.explode(F.element_at(wild, F.col("k") + 1)).alias("w"))
              .select("w", F.col("fp").bitwiseAND(F.bitwise_not("w")).alias("v"), "rep"))
    stars = (masked.groupBy("w", "v").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
             .select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a <> b"))
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row per input row.

    ``component_id`` is the smallest id reachable over links. A null text is an
    empty text; texts without words share fingerprint zero and so one group.
    Repeated rows are copies. A null id takes its group's smallest id, null if
    the group has none. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, shingle, id_col, text_col))
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(links(fps, distance)).select(F.col("node").alias("rep"), "component")
    named = (fps.join(found, "rep", "left")
             .select("fp", F.coalesce("component", "rep").alias("component_id")))
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
