"""Packing documents into as few token sequences as possible.

Documents become token pieces of at most ``cap`` tokens (Spark, one pass).
The plan needs only how many pieces have each length, at most ``cap`` numbers:

1. Linear grouping: the large lengths, longest first, are cut into ``groups``
   groups of equal cardinality and each is rounded up to its group's longest.
2. Configurations: for the largest group still open, a knapsack over the group
   sizes finds the companions that fill a sequence best; the configuration is
   used as often as every group in it allows.
3. Substitution: the groups' actual pieces take the places, longest first.
4. Best fit: the small lengths, longest first, go to the fullest sequences
   that can hold them; new sequences are opened only when none can.

Sequences with the same lengths are kept as one run (slots x multiplicity), so
the plan's size follows the number of lengths, not of pieces. A piece finds its
place from its rank among the pieces of its length; ranks are numbered by
Spark in slices, so no length is numbered in one task.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gearsight.llm.common import Shared, id_and_text, slices, worker_cache, written

CAP = 1024
END_ID = 2
GROUPS = (256, 512, 1024)   # numbers of groups of equal cardinality tried for the large lengths
SMALL = (4, 8)          # lengths up to cap / SMALL are small
SLICE = 100_000         # ranks numbered by one window task
CACHE = 600_000         # words whose ids a Python worker keeps


# --- tokens -------------------------------------------------------------------------------

# Byte-level BPE files write every byte as a printable character: printable
# ones as themselves, the others from code point 256 on, in byte order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {x: x for x in _SHOWN} | {x: 256 + i for i, x in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class WordCachedTokenizer:
    """Ids of a byte-level BPE file, kept by word.

    The vocabulary's split rule never joins a character to one after a single
    space or line feed that stands between non-spaces, so such a text is the
    sequence of its ``" word"`` and ``"\\n"`` chunks; a word of letters with one
    stop or comma behind it is two pieces of that rule. Texts with any
    other white space are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # one task, one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.chunks: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        body = chunk[chunk[0] == " ":]
        if body.isalpha():
            shown = chunk.encode().decode("latin-1").translate(_BYTE_CHARS)
            return np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return self._get(chunk[:-1]) + self._get(body[-1])
        return self._whole(chunk)

    def _get(self, chunk: str) -> bytes:
        ids = self.chunks.get(chunk)
        if ids is None:
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            ids = self.chunks[chunk] = self._chunk(chunk) if len(chunk) > 1 else self._whole(chunk)
        return ids

    def encode(self, text: str) -> np.ndarray:
        words, gaps = text.split(), text.count(" ") + text.count("\n")
        if gaps != len(words) - 1 or gaps != len(text) - len("".join(words)) or "\0" in text:
            return np.frombuffer(self._whole(text), "<u4")      # white space other than single spaces and line feeds
        chunks = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        ids = list(map(self.chunks.get, chunks))
        if None in ids:
            ids = [self._get(c) if i is None else i for c, i in zip(chunks, ids)]
        return np.frombuffer(b"".join(ids), "<u4")


def _tokenizer(path: str) -> WordCachedTokenizer:
    cache = worker_cache("tokenizers")
    if path not in cache:
        cache[path] = WordCachedTokenizer(path)
    return cache[path]


def token_pieces(docs: DataFrame, path: str, cap: int = CAP, end_id: int = END_ID, keep_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each text's ids, then
    ``end_id``, cut from the end into pieces of ``cap`` tokens, so only the
    first piece can be shorter. A null text is an empty one (one token)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        tok = _tokenizer(path)
        for batch in batches:
            for part, text in slices(batch):
                rows = []
                for doc, t in zip(part.column(0).to_pylist(), text):
                    ids = np.append(tok.encode(t) if t else np.empty(0, "<u4"), np.array(end_id, "<u4")).astype("<u4")
                    first = (len(ids) - 1) % cap + 1
                    edges = [0, *range(first, len(ids) + 1, cap)]
                    for i, (a, b) in enumerate(zip(edges, edges[1:])):
                        rows.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b]))
                cols = list(zip(*rows))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(
                    pa.array(c, pa.int64()) for c in cols[2:5])]
                if keep_ids:
                    arrays.append(pa.array([c.astype(np.int32) for c in cols[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"]
                                                 + ["ids"] * keep_ids)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


# --- the plan -----------------------------------------------------------------------------

class Run:
    """``n`` sequences alike: slot ``(length, rank)`` holds the pieces of that
    length with ranks ``rank .. rank + n - 1``, one in each sequence."""

    __slots__ = ("slots", "n")

    def __init__(self, slots, n):
        self.slots, self.n = slots, n

    def split(self, at: int) -> tuple["Run", "Run"]:
        return Run(self.slots, at), Run([(x, r + at) for x, r in self.slots], self.n - at)


def _groups(counts: dict[int, int], n: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in ``n`` groups of equal cardinality."""
    size = max(1, -(-sum(counts.values()) // n))
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = size
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return out


def _companions(sizes: list[int], have: list[int], room: int) -> list[int]:
    """Bounded knapsack: group indices (with repeats) that fill ``room`` best."""
    best = np.full(room + 1, -1)          # the last group used to reach a fill
    best[0] = len(sizes)
    for g, (s, h) in enumerate(zip(sizes, have)):
        for _ in range(min(h, room // s)):
            new = np.flatnonzero((best[s:] < 0) & (best[:-s] >= 0)) + s
            if not len(new):
                break
            best[new] = g
    # a group may now be counted more often than it has; walk back and check
    for fill in np.flatnonzero(best >= 0)[::-1].tolist():
        left, out = list(have), []
        while fill > 0:
            g = int(best[fill])
            left[g] -= 1
            if left[g] < 0:
                break
            out.append(g)
            fill -= sizes[g]
        else:
            return out
    return []


def _configurations(groups: list[list[tuple[int, int]]], cap: int) -> list[tuple[list[int], int]]:
    sizes, left = [g[0][0] for g in groups], [sum(n for _, n in g) for g in groups]
    out = []
    for g in range(len(groups)):
        while left[g]:
            have = [0] * g + left[g:]
            have[g] -= 1
            use = [g, *_companions(sizes, have, cap - sizes[g])]
            need = {x: use.count(x) for x in use}
            times = min(left[x] // k for x, k in need.items())
            for x, k in need.items():
                left[x] -= times * k
            out.append((use, times))
    return out


def plan(counts: dict[int, int], cap: int = CAP, groups: tuple = GROUPS) -> list[Run]:
    """Runs that hold every piece of ``counts`` (pieces by length) once: the plan
    with the fewest sequences over ``groups`` and ``SMALL``."""
    return min((_plan(counts, cap, g, s) for g in groups for s in SMALL), key=lambda runs: sum(r.n for r in runs))


def _plan(counts: dict[int, int], cap: int, groups: int, small: int) -> list[Run]:
    if any(not 1 <= x <= cap for x in counts):
        raise ValueError("a piece's length lies outside 1..cap")
    used: dict[int, int] = defaultdict(int)
    runs = []
    if counts.get(cap):
        runs.append(Run([(cap, 0)], counts[cap]))
    large = {x: n for x, n in counts.items() if cap // small < x < cap}
    grouped = _groups(large, groups) if large else []
    for use, times in _configurations(grouped, cap):
        while times:
            # the longest pieces left of each group, as many sequences as are alike
            need = {g: use.count(g) for g in use}
            take = min([times] + [max(1, grouped[g][0][1] // k) for g, k in need.items()])
            placed = []
            for g in use:
                length, have = grouped[g][0]
                placed.append((length, used[length]))
                used[length] += take
                if have == take:
                    grouped[g].pop(0)
                else:
                    grouped[g][0] = (length, have - take)
            runs.append(Run(placed, take))
            times -= take
    open_runs: dict[int, list[Run]] = defaultdict(list)
    for r in runs:
        open_runs[cap - sum(x for x, _ in r.slots)].append(r)
    rooms = sorted(open_runs)
    for length in sorted((x for x in counts if x <= cap // small and x < cap), reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = cap // length
                new = Run([], -(-left // per))
                room = cap
                if new.n * per != left:
                    new.n = max(1, left // per)
            else:
                room = rooms[at]
                new = open_runs[room].pop()
                if not open_runs[room]:
                    rooms.pop(at)
                    del open_runs[room]
            per = min(room // length, left)
            if left // per < new.n:
                new, rest = new.split(left // per)
                if rest.slots:
                    if room not in open_runs:
                        insort(rooms, room)
                    open_runs[room].append(rest)
            slots = list(new.slots)
            for _ in range(per):
                slots.append((length, used[length]))
                used[length] += new.n
                left -= new.n
            new = Run(slots, new.n)
            room -= per * length
            if room not in open_runs:
                insort(rooms, room)
            open_runs[room].append(new)
    return [r for group in open_runs.values() for r in group]


def places(runs: list[Run]) -> pd.DataFrame:
    """``(length, rank, sequence, offset)``: from ``rank`` on, a length's pieces
    lie in consecutive sequences from ``sequence`` on, at ``offset``."""
    rows, first = [], 0
    for r in runs:
        offset = 0
        for length, rank in r.slots:
            rows.append((length, rank, first, offset))
            offset += length
        first += r.n
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"])


# --- the Spark job ------------------------------------------------------------------------

def ranked(pieces: DataFrame, key: str, order: list[str], slice_rows: int = SLICE) -> DataFrame:
    """``pieces`` with ``rank`` from 0 among the rows of equal ``key``: counts of
    hashed slices give each slice its first rank, a window numbers inside."""
    most = pieces.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    n = max(8, -(-most // slice_rows))
    cut = pieces.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    first = (cut.groupBy(key, "_slice").count()
             .withColumn("_first", F.sum("count").over(Window.partitionBy(key).orderBy("_slice")) - F.col("count"))
             .drop("count"))
    inside = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*order)) - 1
    return (cut.withColumn("_in", inside).join(first, [key, "_slice"])
            .withColumn("rank", F.col("_first") + F.col("_in")).drop("_slice", "_first", "_in"))


def pack(docs: DataFrame, tokenizer_path: str, cap: int = CAP, end_id: int = END_ID, groups: tuple = GROUPS,
         keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)``,
    one row per piece; sequences are gapless from offset 0 and hold at most
    ``cap`` tokens. A null or empty text is one piece of one token. Repeated
    rows are packed each; rows with a null id like any other. An empty table
    gives no rows. ``sequence_id`` numbers sequences of this call."""
    pieces = written(token_pieces(docs, tokenizer_path, cap, end_id, keep_ids, id_col, text_col))
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}   # cap rows at most
    table = places(plan(counts, cap, groups))
    shared = Shared(docs.sparkSession,           # follows the number of lengths, not of pieces
        tuple(table[c].to_numpy(np.int64) for c in table.columns))

    def place(batches):
        length, rank, sequence, offset = shared.value
        wide = np.int64(1) << 44
        keys = length * wide + rank
        for batch in batches:
            t = pa.table(batch) if isinstance(batch, dict) else batch
            x = t.column(t.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            r = t.column(t.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, x * wide + r, side="right") - 1
            names = [n for n in t.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [t.column(t.schema.get_field_index(n)) for n in names]
                + [pa.array(sequence[at] + r - rank[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])
    named = ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"])
    named = named.select(*pieces.columns, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return named.mapInArrow(place, schema + ", sequence_id long, offset long")
