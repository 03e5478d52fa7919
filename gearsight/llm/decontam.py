"""Benchmark decontamination.

1. Test items and documents are folded to words; every ``n`` words of an item make
   a seed. A seed of one item only is rare: it joins documents to that item.
2. A seed that several items share says little by itself. It joins together with
   its companions, the item's rarest words: an alignment that reaches the
   threshold needs so many of the item's words that at least ``least`` of the
   companions lie near the seed. Documents count companions by (seed, word) keys,
   so a phrase common to many items and many documents makes no pairs of its own,
   and no passage that could reach the threshold is lost.
3. Pairs travel as ids. Where a document holds a seed of an item it was joined to,
   the words around it are aligned with the item by Smith-Waterman, unless too few
   of the item's words lie there. A document is contaminated if the score reaches
   ``threshold`` of the item's own.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import Shared, id_and_text, shingle_hashes, slices, written

SEED_WORDS = 3
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
KEY_BITS = 16               # bits of a filter table per key; more keys than fit in TABLE_BITS only pass more rows on
TABLE_BITS = 30             # a filter table has at most 2**30 bits, 128 MB

_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII marks separate words."""
    return text.lower().encode().translate(_BLANK).split()


def seed_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Hashes of every run of ``n`` words; none if there are fewer."""
    return shingle_hashes(words, n).view(np.int64) if len(words) >= n else np.empty(0, np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word-id arrays: score and the passage position
    behind its last word. One row per item word; the gap along the passage is
    a running maximum."""
    best, at = 0, 0
    row, slope = np.zeros(len(passage) + 1, np.int64), -GAP * np.arange(len(passage) + 1)
    for w in item.tolist():
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), 0)
        new = np.maximum(new, row + GAP)
        new = np.maximum.accumulate(new + slope) - slope
        row = np.maximum(new, 0)
        top = int(row.argmax())
        if row[top] > best:
            best, at = int(row[top]), top
    return best, at


def most_matches(item: np.ndarray, passage: np.ndarray) -> int:
    """Words of the item (ids from 0) that find a partner in the passage in any
    order; -1 is no word of the item. No alignment has more matches."""
    have = np.bincount(passage[passage >= 0], minlength=int(item.max(initial=0)) + 1)
    return int(np.minimum(np.bincount(item, minlength=len(have)), have).sum())


def mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One key for every seed of ``h`` with every word hash of ``w`` (a row per seed)."""
    x = h.view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64)[None, :]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


ALONE = np.zeros(1, np.int64)           # in place of a word: the seed's own words reach the threshold


def companions(words: list[bytes], rarity: dict[int, int], shared: set[int], n: int, threshold: float):
    """``(key, seed, weight, least)`` of an item's shared seeds: documents whose
    keys of a seed weigh less than ``least`` hold no passage that reaches
    ``threshold``. Weights are occurrences in the item; rare words come first."""
    hashes = shingle_hashes(words, 1).view(np.int64)
    times = Counter(hashes.tolist())
    ranked = sorted(times, key=lambda w: (rarity.get(w, 0), w))
    out = []
    for at, h in enumerate(seed_hashes(words, n).tolist()):
        if h not in shared:
            continue
        shared.discard(h)
        own = set(hashes[at:at + n].tolist())
        others = len(words) - sum(times[w] for w in own)
        need = math.ceil(threshold * len(words) - 1e-9) - (len(words) - others)
        if need <= 0:
            out.append((int(mixed(np.array([h]), ALONE)[0, 0]), h, 1, 1))
            continue
        chosen, weight = [], 0
        for w in ranked:
            if weight >= others - need + (need + 1) // 2:
                break
            if w not in own:
                chosen.append(w)
                weight += times[w]
        keys = mixed(np.array([h]), np.array(chosen, np.int64))[0].tolist()
        out += [(key, h, times[w], weight - (others - need)) for key, w in zip(keys, chosen)]
    return out


def _seeds(items: DataFrame, n: int) -> DataFrame:
    """``(item, h, words)``, the distinct seeds of each item: ``n`` words or, for a
    shorter item, all its words. Items without words have none."""
    def run(batches):
        for batch in batches:
            for part, text in slices(batch):
                rows = []
                for item, t in zip(part.column(0).to_pylist(), text):
                    words = words_of(t)
                    if words:
                        rows += [(item, h, len(words))
                                 for h in np.unique(seed_hashes(words, min(n, len(words)))).tolist()]
                cols = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())],
                    names=["item", "h", "words"])
    return items.mapInArrow(run, "item long, h long, words int")


def _words(items: DataFrame) -> DataFrame:
    """``(item, w)``: hashes of each item's distinct words."""
    def run(batches):
        for batch in batches:
            for part, text in slices(batch):
                found = [np.unique(shingle_hashes(words_of(t), 1).view(np.int64)) for t in text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), [len(f) for f in found])),
                     pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], names=["item", "w"])
    return items.mapInArrow(run, "item long, w long")


def _anchors(items: DataFrame, seeds: DataFrame, n: int, threshold: float) -> DataFrame:
    """``(key, item, h, weight, least, alone)``: a rare seed is a key ``alone``, a shared
    one has a key with each companion."""
    counted = seeds.join(seeds.groupBy("h").agg(F.count("*").alias("holders")), "h")
    rare = counted.where("holders = 1").select(F.col("h").alias("key"), "item", "h", F.lit(1).alias("weight"),
                                               F.lit(1).alias("least"), F.lit(True).alias("alone"))
    shared = counted.where("holders > 1").groupBy("item").agg(F.collect_list("h").alias("shared"))    # an item's own
    held = _words(items.join(shared, "item", "left_semi"))
    rarity = held.join(_words(items).groupBy("w").agg(F.count("*").alias("f")), "w").groupBy("item").agg(
        F.collect_list("w").alias("w"), F.collect_list("f").alias("f"))

    def run(batches):
        for batch in batches:
            for part, text in slices(batch):
                rows = []
                for r, t in zip(part.drop_columns(["text"]).to_pylist(), text):
                    words = words_of(t)
                    rows += [(key, r["item"], h, weight, least, False) for key, h, weight, least in companions(
                        words, dict(zip(r["w"], r["f"])), set(r["shared"]), min(n, len(words)), threshold)]
                cols = list(zip(*rows)) or [[]] * 6
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                 names=["key", "item", "h", "weight", "least", "alone"])
    keyed = items.join(shared, "item").join(rarity, "item").select("item", "text", "shared", "w", "f").mapInArrow(
        run, "key long, item long, h long, weight int, least int, alone boolean")
    return rare.unionByName(keyed)


def _bits(keys: DataFrame) -> np.ndarray:
    """A table of the bits of all keys, eight to a byte; its size follows their number."""
    size = 1 << min(TABLE_BITS, max(16, (KEY_BITS * keys.count()).bit_length()))
    bit = F.col(keys.columns[0]).bitwiseAND(F.lit(size - 1)).alias("bit")
    pages = (keys.select(bit).distinct().groupBy(F.shiftright("bit", 16).alias("page"))
             .agg(F.collect_list(F.col("bit").bitwiseAND(F.lit(0xFFFF)).cast("int")).alias("bits")))   # at most 2**16 a page
    table = np.zeros(size >> 3, np.uint8)
    for r in pages.toLocalIterator():
        page = np.zeros(1 << 16, np.uint8)
        page[np.array(r["bits"], np.int64)] = 1
        table[r["page"] << 13:(r["page"] + 1) << 13] = np.packbits(page, bitorder="little")
    return table


def seen(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set."""
    bit = keys & (8 * len(table) - 1)
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def near_keys(words: list[bytes], pos: np.ndarray, h: np.ndarray, reach: int, table: np.ndarray) -> list[np.ndarray]:
    """Keys in ``table`` of shared seeds ``h`` at ``pos`` with the words around them;
    what lies within ``reach`` of chained seeds is one neighbourhood."""
    order = np.argsort(pos, kind="stable")
    pos, h = pos[order], h[order]
    edges = [0, *(np.flatnonzero(np.diff(pos) > 2 * reach) + 1).tolist(), len(pos)]
    out = []
    for a, b in zip(edges, edges[1:]):
        near = [shingle_hashes([w], 1) for w in set(words[max(0, int(pos[a]) - reach):int(pos[b - 1]) + reach])]
        near, hs = np.append(np.concatenate(near).view(np.int64), ALONE), np.unique(h[a:b])
        step = max(1, (1 << 20) // len(near))
        for c in range(0, len(hs), step):
            keys = mixed(hs[c:c + step], near).ravel()
            out.append(keys[seen(table, keys)])
    return out


def _hits(docs: DataFrame, tables, sizes: list[int], reach: int) -> DataFrame:
    """``(doc_id, keys)``: the possible keys of each document that holds any."""
    def run(batches):
        seeds, shared, companion = tables.value
        for batch in batches:
            for part, text in slices(batch):
                rows = []
                for i, t in zip(part.column(0).to_pylist(), text):
                    words = words_of(t)
                    keys, pos, held = [], [], []
                    for n in sizes:
                        h = seed_hashes(words, n)
                        at = np.flatnonzero(seen(seeds, h))
                        keys.append(h[at])
                        at = at[seen(shared, h[at])]
                        pos.append(at)
                        held.append(h[at])
                    if sum(map(len, pos)):
                        keys += near_keys(words, np.concatenate(pos), np.concatenate(held), reach, companion)
                    if sum(map(len, keys)):
                        rows.append((i, np.unique(np.concatenate(keys))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                                      pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                                                     names=["doc_id", "keys"])
    return docs.mapInArrow(run, "doc_id long, keys array<long>")


class Passages:
    """A document's words, asked for the best aligned passage of one item after another."""

    def __init__(self, text: str, n: int):
        words, self.n = words_of(text), n
        self.ids = {w: i for i, w in enumerate(set(words))}
        self.at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def best(self, item: list[bytes], threshold: float) -> tuple[float, int]:
        """The alignment's share of the item's own score, and the word behind it."""
        ids = {w: i for i, w in enumerate(dict.fromkeys(item))}
        want = np.array([ids[w] for w in item], np.int64)
        known = np.full(len(self.ids) + 1, -1, np.int64)         # the item's number of each word of the document
        for w, i in ids.items():
            known[self.ids.get(w, -1)] = i
        known[-1] = -1
        words = known[self.at]
        if most_matches(want, words) / len(item) < threshold:
            return 0.0, 0
        slack = max(8, len(item) // 2)
        spans: list[list[int]] = []
        for s in _starts(want, words, min(self.n, len(item))):
            lo, hi = max(0, s - slack), min(len(words), s + len(item) + slack)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
        best = (0, 0)
        for lo, hi in spans:
            if most_matches(want, words[lo:hi]) / len(item) < threshold:
                continue
            score, end = align(want, words[lo:hi])
            best = max(best, (score, lo + end))
        return best[0] / (MATCH * len(item)), best[1]


def _starts(item: np.ndarray, words: np.ndarray, size: int) -> list[int]:
    """Where the item would begin, by each run of ``size`` words that both hold."""
    if len(words) < size:
        return []
    base = int(item.max()) + 2

    def codes(of):
        return sum((of[i:len(of) - size + 1 + i] + 1) * base ** (size - 1 - i) for i in range(size))
    seeds, h = codes(item), codes(words)
    at = np.flatnonzero(np.isin(h, seeds))
    order = np.argsort(seeds, kind="stable")
    lo, hi = np.searchsorted(seeds[order], h[at], "left"), np.searchsorted(seeds[order], h[at], "right")
    return sorted({p - int(i) for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()) for i in order[a:b]})


def _aligned(n: int, threshold: float):
    def run(batches):
        for batch in batches:
            for part, text in slices(batch):
                out = []
                for i, t, items in zip(part.column(0).to_pylist(), text, part.column(2).to_pylist()):
                    doc = Passages(t, n)
                    for c in items:
                        share, end = doc.best(words_of(c["item_text"]), threshold)
                        if share >= threshold:
                            out.append((i, c["item"], share, end))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
                         pa.array(cols[3], pa.int64())], names=["doc_id", "item", "score", "end_word"])
    return run


def candidates(docs: DataFrame, items: DataFrame, n: int = SEED_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item)``: pairs to align, of ``docs(doc_id, text)`` and ``items(item,
    text)`` with one row per item. No pair that reaches ``threshold`` is missing."""
    spark = docs.sparkSession
    seeds = written(_seeds(items, n))
    anchors = written(_anchors(items, seeds, n, threshold))
    sizes = sorted(r[0] for r in seeds.select(F.least("words", F.lit(n))).distinct().collect())   # at most n numbers
    longest = seeds.agg(F.max("words")).first()[0] or 0
    reach = longest + max(8, longest // 2) + n              # from a seed to the ends of any span around it
    tables = Shared(spark, tuple(_bits(k) for k in (
        seeds.select("h").distinct(), anchors.where("not alone").select("h").distinct(),
        anchors.where("not alone").select("key"))))
    hits = written(_hits(docs, tables, sizes, reach))
    return (hits.select("doc_id", F.explode("keys").alias("key")).join(anchors, "key")
            .groupBy("doc_id", "item", "h").agg(F.sum("weight").alias("weight"), F.max("least").alias("least"))
            .where("weight >= least").select("doc_id", "item").distinct())


def contaminated(docs: DataFrame, items: DataFrame, n: int = SEED_WORDS, threshold: float = THRESHOLD,
                 id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, score, end_word)``: one row per document and test item
    found in it. ``score`` is the alignment's share of the item's own score, at
    most 1; ``end_word`` is where the best aligned passage ends.

    Null texts are empty; texts or items without words match nothing. Repeated
    rows of one id, document or item, give one row per pair of ids: the best, of
    equal scores the last in the document. Rows with a null document or item id
    are left out, as they cannot be named. No items or no documents give no rows.
    """
    docs = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    named = id_and_text(items, item_id, item_text).where("doc_id is not null").distinct()
    # equal texts are one item, with a number that all later reads see alike
    texts = written(named.groupBy("text").agg(F.collect_list("doc_id").alias("item_ids"))     # the benchmark's own copies
                    .withColumn("item", F.monotonically_increasing_id()))
    one = texts.select("item", "text")
    per_doc = (candidates(docs, one, n, threshold).join(one.withColumnRenamed("text", "item_text"), "item")
               .groupBy("doc_id").agg(F.collect_list(F.struct("item", "item_text")).alias("items")))
    # a shuffle join at every size: the candidates grow with the documents
    return (docs.hint("merge").join(written(per_doc), "doc_id").select("doc_id", "text", "items")
            .mapInArrow(_aligned(n, threshold), "doc_id long, item long, score double, end_word long")
            .join(texts.select("item", F.explode("item_ids").alias("item_id")), "item")
            .groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end_word")).alias("b"))
            .select("doc_id", "item_id", "b.score", "b.end_word"))
