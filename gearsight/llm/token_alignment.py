"""Alignment of two tokenizers over the same texts, and how often token pairs meet.

1. Each batch of documents is encoded on both sides (A: a byte-level BPE file on
   space + text; B: a piece model, which adds that space itself). Token bytes put
   together must give space + text on both sides; else a document has no tokens.
2. Tokens become rows ``(document, start, end, id)``. ``pandas.merge_asof``, keyed by
   document, finds for each token start the token of the other side that covers it;
   the union of both directions is every overlap. Offsets where both sides end a
   token cut the tokens into groups.
3. A document's different id pairs, with their numbers of links, are written. Pairs
   are summed per task, then by Spark: in how many documents is a pair linked, and
   is that the highest count of its A id?
4. The documents look their pairs up. The most frequent pairs, at most ``FREQUENT``
   of them whatever the input, are sent to every task; all others are joined.
"""

from __future__ import annotations

import json
import os
from array import array
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gearsight.llm.common import Shared, id_and_text, pieces, worker_cache, written
from gearsight.llm.packing import _BYTE_CHARS

CACHE = 500_000             # words whose ids a Python worker keeps
SLICE_BYTES = 1 << 20       # text worked on at once; one document is never cut
FREQUENT = 1 << 19          # pairs sent to every task: 16 bytes each
HELD_PAIRS = 1 << 21        # pairs a task sums up before it passes them on

_SPACE = "▁"           # fixed value: how piece models write a space


class Encoders:
    """Both tokenizers with the bytes of every id; ids are kept by word."""

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # one task, one core
        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True         # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        back = {chr(c): x for x, c in _BYTE_CHARS.items()}
        with open(byte_file, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(back.__getitem__, token)) if back.keys() >= set(token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(_SPACE, " ").encode()
                        for i, n in enumerate(names)]
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes)]
        shown = [np.array([f"{i}{sep}" for sep in seps for i in range(len(x))], object)
                 for x, seps in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))]
        self.shown = shown
        # words can be encoded alone if no piece goes on behind a space or holds a line feed
        self.by_word = not any(_SPACE in n.lstrip(_SPACE) or "\n" in n for n in names)
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.changed: set[str] = set()              # chunks whose bytes a side does not give back
        self.stops = {x: self.a_whole(x) for x in ".,"}

    def a_whole(self, text: str) -> bytes:
        return array("I", self.a.encode(text, add_special_tokens=False).ids).tobytes()

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        return self.a_whole(" " + text), array("I", self.b.encode(text)).tobytes()

    def _same(self, ids: tuple[bytes, bytes], want: bytes) -> bool:
        return all(b"".join(map(of.__getitem__, array("I", side))) == want
                   for side, of in zip(ids, (self.a_bytes, self.b_bytes)))

    def _chunks(self, text: str) -> list[str] | None:
        """Space + text cut before every space and around line feeds, where both
        vocabularies never join; None if there is other white space."""
        words, gaps = text.split(), text.count(" ") + text.count("\n")
        if not self.by_word or gaps != len(words) - 1 or gaps != len(text) - len("".join(words)) or "\0" in text:
            return None
        return (" " + text.replace("\n", "\0\n\0").replace(" ", "\0 ")).split("\0")

    def _a_chunk(self, chunk: str) -> bytes:
        """A word is one piece of the byte-level split rule, and so is one stop or comma behind it."""
        body = chunk[chunk[0] == " ":]
        if body.isalpha():
            shown = chunk.encode().decode("latin-1").translate(_BYTE_CHARS)
            return array("I", [t.id for t in self.a.model.tokenize(shown)]).tobytes()
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return (self.known_a.get(chunk[:-1]) or self._a_chunk(chunk[:-1])) + self.stops[body[-1]]
        return self.a_whole(chunk)

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks. The model adds a space, which chunks that begin with
        one leave out; others get a line feed in front, and lose both again."""
        spaced = [c[0] == " " for c in chunks]
        found = self.b.encode([c[1:] if s else "\n" + c for c, s in zip(chunks, spaced)], num_threads=1)
        for c, s, ids in zip(chunks, spaced, found):
            ids = self._a_chunk(c), array("I", ids if s else ids[2:]).tobytes()
            self.known_a[c], self.known_b[c] = ids
            if not self._same(ids, c.encode()):
                self.changed.add(c)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(A ids, B ids)`` of each text; no ids where the bytes of a side differ."""
        cut = [self._chunks(t) if t else None for t in texts]
        if len(self.known_a) > CACHE:
            self.known_a, self.known_b, self.changed = {}, {}, set()
        if new := list(set(chain.from_iterable(c for c in cut if c)).difference(self.known_a)):
            self._learn(new)
        out = []
        for text, chunks in zip(texts, cut):
            if chunks:
                ids = b"".join(map(self.known_a.__getitem__, chunks)), b"".join(map(self.known_b.__getitem__, chunks))
            else:
                ids = self._whole(text) if text else (b"", b"")
            if not chunks or not self.changed.isdisjoint(chunks):
                ids = ids if text and self._same(ids, b" " + text.encode()) else (b"", b"")
            out.append(tuple(np.frombuffer(x, "<u4") for x in ids))
        return out


def _rows(side: list[np.ndarray], sizes: np.ndarray) -> pd.DataFrame:
    """A row for each token; offsets run on over the documents, which are as long on both sides."""
    ids = np.concatenate(side) if side else np.empty(0, "<u4")
    ends = np.cumsum(sizes[ids])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(side)), [len(x) for x in side]), "start": ends - sizes[ids],
                         "end": ends, "id": ids.astype(np.int64), "at": np.arange(len(ids))})


def links(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers ``(in a, in b)`` of all overlapping tokens, each once."""
    ab = pd.merge_asof(a[["doc", "start", "at"]], b[["doc", "start", "at"]], on="start", by="doc", suffixes=("", "_other"))
    ba = pd.merge_asof(b[["doc", "start", "at"]], a[["doc", "start", "at"]].assign(begin=a["start"]), on="start", by="doc",
                       suffixes=("", "_other"))
    ba = ba[ba["start"] > ba["begin"]]              # equal starts are in ab
    return (np.concatenate([ab["at"], ba["at_other"]]).astype(np.int64),
            np.concatenate([ab["at_other"], ba["at"]]).astype(np.int64))


def _grouped(a: pd.DataFrame, b: pd.DataFrame, docs: int, shown) -> tuple[np.ndarray, list[str]]:
    """Per document the number of groups and the groups as ``a1,a2|b1;a3|b2,b3``."""
    cuts = np.intersect1d(a["end"], b["end"], assume_unique=True)
    group = [np.searchsorted(cuts, x["end"]) for x in (a, b)]
    ends_a = np.isin(a["end"], cuts)
    names = [text[np.where(np.append(g[1:] != g[:-1], True), len(text) // 2, 0) + x["id"].to_numpy()] if len(x) else text[:0]
             for x, g, text in ((a, group[0], shown[0]), (b, group[1], shown[1]))]
    order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
    names = np.concatenate(names)[order].tolist()
    doc = np.concatenate([a["doc"], b["doc"]])[order]
    edges = np.searchsorted(doc, np.arange(docs + 1))
    return (np.bincount(a["doc"][ends_a], minlength=docs),
            ["".join(names[i:j])[:-1] for i, j in zip(edges[:-1], edges[1:])])


def align_batch(encoders: Encoders, texts: list[str]) -> dict[str, list]:
    """The columns of :func:`align` for some texts."""
    ids = encoders.encode(texts)
    a, b = (_rows([x[k] for x in ids], encoders.sizes[k]) for k in (0, 1))
    in_a, in_b = links(a, b)
    n_groups, groups = _grouped(a, b, len(texts), encoders.shown)
    doc, width = a["doc"].to_numpy()[in_a], len(encoders.b_bytes)
    pair = a["id"].to_numpy()[in_a] * width + b["id"].to_numpy()[in_b]
    n_links = np.bincount(doc, minlength=len(texts)).tolist()
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    first = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(pair, prepend=-1))
    times = np.diff(np.append(first, len(pair))).astype("<u4")
    edges = np.searchsorted(doc[first], np.arange(len(texts) + 1))
    packed = pair[first].astype(pair_type(len(encoders.a_bytes), width))
    spans = list(zip(edges[:-1], edges[1:]))
    return {"n_a": [len(x) for x, _ in ids], "n_b": [len(x) for _, x in ids], "n_groups": n_groups.tolist(),
            "n_links": n_links, "groups": groups,
            "pairs": [packed[i:j].tobytes() for i, j in spans], "times": [times[i:j].tobytes() for i, j in spans]}


def pair_type(a_ids: int, b_ids: int) -> str:
    return "<u4" if a_ids * b_ids < 1 << 32 else "<u8"


def _encoders(byte_file: str, piece_file: str) -> Encoders:
    cache = worker_cache("alignment")
    if (byte_file, piece_file) not in cache:
        cache[byte_file, piece_file] = Encoders(byte_file, piece_file)
    return cache[byte_file, piece_file]


_COUNTS = "n_a long, n_b long, n_groups long, n_links long"


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times)``, one row per row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of both sides between offsets where both
    end. ``pairs`` packs the different linked ids, ``a * |B| + b`` ascending, as
    little-endian unsigned integers of :func:`pair_type`; ``times`` how many links
    each has, 32 bits. A null or empty text, and one whose bytes a side does not give
    back, has no tokens: zeros and empty values. Rows with null or repeated ids are
    rows like any other. No rows give no rows. Both files lie at the same path on
    every machine.
    """
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches):
        encoders = _encoders(byte_file, piece_file)
        for batch in batches:
            for part, texts in pieces(batch, "text", SLICE_BYTES):
                columns = align_batch(encoders, texts)
                yield pa.record_batch([part.column(0), *map(pa.array, columns.values(), kinds)], names=["doc_id", *columns])
    return (id_and_text(docs, id_col, text_col)
            .mapInArrow(run, f"doc_id long, {_COUNTS}, groups string, pairs binary, times binary"))


# --- counts over all documents ------------------------------------------------------------

def _document_counts(aligned: DataFrame, kind: str) -> DataFrame:
    """``(pair, n)``: in how many documents each pair is linked."""
    def summed(blobs):
        pair, n = np.unique(np.frombuffer(b"".join(blobs), kind), return_counts=True)
        return pa.record_batch([pa.array(pair.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(blob)
                size += len(blob)
                if size >= HELD_PAIRS * np.dtype(kind).itemsize:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)
    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the highest count levels, ``most`` at most, ascending, with ``n`` and
    ``best``. Levels are eighths of a power of two, so there are a few hundred."""
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"])
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    rows = counts.where(level >= least).toPandas().sort_values("pair")
    return rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(bool)


def _probed(aligned: DataFrame, frequent, kind: str) -> DataFrame:
    """Sums over the frequent pairs of each row, and its other pairs."""
    shared = Shared(aligned.sparkSession, frequent)

    def run(batches):
        pairs, n, best = shared.value
        for batch in batches:
            for part, blobs in pieces(batch, "pairs", SLICE_BYTES):
                own = np.frombuffer(b"".join(blobs), kind).astype(np.int64)
                times = np.frombuffer(b"".join(part.column(part.schema.get_field_index("times")).to_pylist()), "<u4").astype(np.int64)
                of = np.repeat(np.arange(len(blobs)), [len(x) // np.dtype(kind).itemsize for x in blobs])
                at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
                hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)

                def total(values):
                    sums = np.concatenate([[0], np.cumsum(values)])
                    edges = np.searchsorted(of[hit], np.arange(len(blobs) + 1))
                    return pa.array(np.diff(sums[edges]))
                edges = pa.array(np.searchsorted(of[~hit], np.arange(len(blobs) + 1)).astype(np.int32))
                rest = [pa.ListArray.from_arrays(edges, pa.array(x[~hit])) for x in (own, times)]
                yield pa.record_batch([part.column(part.schema.get_field_index("_row")), total((n[at] * times)[hit] if len(pairs) else own[:0]),
                                       total((best[at] * times)[hit] if len(pairs) else own[:0]), *rest],
                                      names=["_row", "count_sum", "n_best", "pairs", "times"])
    return aligned.select("_row", "pairs", "times").mapInArrow(
        run, "_row long, count_sum long, n_best long, pairs array<long>, times array<long>")


def link_counts(aligned: DataFrame, a_ids: int, b_ids: int, most: int = FREQUENT) -> DataFrame:
    """``aligned`` (rows of :func:`align`, ``groups`` not needed) with ``n_best``, the
    links whose pair has the highest document count of its A id, ties included, and
    ``count_sum``, the document counts summed over all links. ``a_ids`` and ``b_ids``
    are the numbers of ids. A repeated row counts as a document of its own."""
    kind = pair_type(a_ids, b_ids)
    aligned = written(aligned.withColumn("_row", F.monotonically_increasing_id()))
    of_a = Window.partitionBy(F.floor(F.col("pair") / b_ids))
    counts = written(_document_counts(aligned, kind).withColumn("best", F.col("n") == F.max("n").over(of_a)))
    probed = written(_probed(aligned, _frequent(counts, most), kind))
    rest = (probed.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
            .select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
            .join(counts, "pair").groupBy("_row")
            .agg(F.sum(F.col("n") * F.col("times")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("_best")))
    zero = F.lit(0).cast("long")
    return (aligned.drop("pairs", "times").join(probed.drop("pairs", "times"), "_row").join(rest, "_row", "left")
            .withColumns({"count_sum": F.col("count_sum") + F.coalesce("_sum", zero),
                          "n_best": F.col("n_best") + F.coalesce("_best", zero)}).drop("_row", "_sum", "_best"))


def vocabulary_sizes(byte_file: str, piece_file: str) -> tuple[int, int]:
    import sentencepiece
    with open(byte_file, encoding="utf-8") as f:
        a = max(json.load(f)["model"]["vocab"].values()) + 1
    return a, sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()
