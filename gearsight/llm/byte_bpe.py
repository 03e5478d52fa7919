"""Byte-level BPE from a rank file: encoding and decoding by DuckDB queries that
run inside each Spark task.

Encoding. The split pattern cuts a text into words; a word that is a token by
itself needs no merging. The others become rows ``(word, position, token id)``,
one per byte, and a recursive query contracts them: neighbours join the merge
table, each word's lowest rank is chosen at its leftmost place, the left row
takes the merged id and the right row goes, until no pair of any word is in the
table. Equal pairs of the same word are contracted in the same round, every
second one of a run, where no merge with the new token ranks below the new token
itself (the table says so): one at a time would do just the same then. The query
stops after ``ROUNDS`` rounds, whose rows it holds, and is asked again with
what is not at its end, so memory follows the bytes however long a word is.

Decoding. Rows ``(document, position, token id)`` join the vocabulary; an
aggregate ordered by position puts each document's bytes together.

A worker keeps the tables and the ids of the words it has met (``CACHE`` of them
at most; this changes time only).
"""

from __future__ import annotations

import base64
import os
import tempfile
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gearsight.llm.common import id_and_text, pieces, worker_cache

CACHE = 600_000             # words whose ids a Python worker keeps
SLICE_BYTES = 2 << 20       # text or ids worked on at once; one document is never cut
ROUNDS = 32                 # rounds of one recursive query

_ENCODE = """
with recursive step(t, p, w, id) as (
  select 0, p, w, id from symbols
  union all
  (with seen as (select t, p, w, id, lead(id) over word as next_id, lead(w) over word as next_w,
                        row_number() over word as i
                 from step window word as (order by p)),
   ranked as (select s.t, s.p, s.w, s.id, s.i, m.merged, m.alone
              from seen s left join merges m on m.l = s.id and m.r = s.next_id and s.next_w = s.w),
   best as (select w, (least // 4294967296)::int as merged, least % 4294967296 as first
            from (select w, min(merged * 4294967296 + i) as least from ranked group by w) where least is not null),
   again as (select r.w, r.i, r.merged from ranked r
             join best b on r.w = b.w and r.merged = b.merged and r.i > b.first where not r.alone),
   hits as (select w, i, merged, true as more from again
            union all select w, first, merged, false from best where w in (select w from again)),
   placed as (select *, row_number() over (partition by w, run order by i) as n
              from (select *, i - row_number() over (order by i) as run from hits)),
   extra as (select i, merged from placed where n % 2 = 1 and more)
   select r.t + 1, r.p, r.w, case when r.i = b.first then b.merged else coalesce(x.merged, r.id) end
   from ranked r join best b on b.w = r.w left join extra x on x.i = r.i
   where r.i <> b.first + 1 and r.i not in (select i + 1 from extra) and r.t < {rounds}))
select s.w, s.id, s.t from step s join (select w, max(t) as t from step group by w) l on s.w = l.w and s.t = l.t
order by s.p
"""

_DECODE = """
select d, list(v.bytes order by t.p) as parts from tokens t join vocabulary v using (id) group by d order by d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token's bytes in base64 and its rank on each line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} has no token for the bytes {missing}")
    return ranks


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """``(left, right, merged)``: every cut of a token into two tokens."""
    return [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks]


class Tables:
    """Merge table and vocabulary of one rank file in a DuckDB of this process, and
    the words met so far."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex
        ranks = read_ranks(path)
        self.ranks, self.split, self.known = ranks, regex.compile(pattern).findall, {}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = merge_rows(ranks)
        alone = {t for left, right, merged in merges for t in (left, right) if merged < t}
        columns = np.array(merges, np.int32).reshape(-1, 3).T
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB",
                                         "temp_directory": f"{tempfile.gettempdir()}/byte-bpe-{os.getpid()}"})
        self.store("merges", pa.table({"l": columns[0], "r": columns[1], "merged": columns[2],
                                       "alone": pa.array([m[2] in alone for m in merges], pa.bool_())}))
        self.store("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()),
                                           "bytes": pa.array(ranks.keys(), pa.binary())}))

    def store(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"create table {name} as select * from given")
        self.db.unregister("given")

    def query(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers, by the recursive query."""
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, words), np.int64, len(words)))
        out = [b""] * len(words)
        while len(ids):
            rows = pa.table({"p": np.arange(len(ids), dtype=np.int32), "w": of, "id": ids})
            got = self.query("symbols", rows, _ENCODE.format(rounds=ROUNDS))
            of, ids, t = (got[c].to_numpy() for c in ("w", "id", "t"))
            done = t < ROUNDS
            flat, ends = ids[done].astype("<u4").tobytes(), of[done]
            edges = np.append(np.flatnonzero(np.diff(ends, prepend=-1)), len(ends))
            for w, a, b in zip(ends[edges[:-1]].tolist(), (4 * edges[:-1]).tolist(), (4 * edges[1:]).tolist()):
                out[w] = flat[a:b]
            of, ids = of[~done], ids[~done]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        known = self.known = self.known if len(self.known) <= CACHE else {}
        cut = [self.split(t) for t in texts]
        ids = [list(map(known.get, words)) for words in cut]
        gaps = [[i for i, x in enumerate(found) if x is None] if None in found else () for found in ids]
        new = {words[i] for words, at in zip(cut, gaps) for i in at}
        ranks = {w: rank for w in new if (rank := self.ranks.get(w.encode())) is not None}
        known.update((w, rank.to_bytes(4, "little")) for w, rank in ranks.items())
        left = list(new.difference(ranks))
        known.update(zip(left, self.merged([w.encode() for w in left])))
        for words, found, at in zip(cut, ids, gaps):
            for i in at:
                found[i] = known[words[i]]
        return list(map(b"".join, ids))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each document's ids stand for."""
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        got = self.query("tokens", pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), lengths),
                                             "p": np.arange(len(flat), dtype=np.int32), "id": flat.view("<i4")}), _DECODE)
        out, known = [b""] * len(ids), 0
        for d, parts in zip(got["d"].to_pylist(), chain.from_iterable(got["parts"].chunks)):
            out[d], known = _joined(parts.values), known + len(parts.values)
        if known != len(flat):
            raise ValueError("an id is not in the vocabulary")
        return out


def _joined(tokens: pa.BinaryArray) -> bytes:
    """All values of an Arrow array in one: its data buffer between the outer offsets."""
    offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset:tokens.offset + len(tokens) + 1]
    return tokens.buffers()[2][int(offsets[0]):int(offsets[-1])].to_pybytes()


def _tables(path: str, pattern: str) -> Tables:
    cache = worker_cache("rank_tables")
    if (path, pattern) not in cache:
        cache[path, pattern] = Tables(path, pattern)
    return cache[path, pattern]


_ENCODED = "doc_id long, n_tokens long, ids binary"
_DECODED = _ENCODED + ", decoded binary"


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def _encoded(docs: DataFrame, rank_file: str, pattern: str, with_decoded: bool) -> DataFrame:
    schema = _DECODED if with_decoded else _ENCODED

    def run(batches):
        tables = _tables(rank_file, pattern)
        for batch in batches:
            for part, texts in pieces(batch, "text", SLICE_BYTES):
                ids = tables.encode(texts)
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if with_decoded:
                    columns.append(pa.array(tables.decode(ids), pa.binary()))
                yield pa.record_batch(columns, names=_names(schema))
    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)``: each row's whole text as token ids, packed as
    little-endian unsigned 32-bit integers, without special tokens.

    ``rank_file`` must lie at the same path on every machine and hold all single
    bytes. A null text is an empty one: no tokens. Rows with null or repeated ids
    are rows like any other; other columns are left out. No rows give no rows.
    """
    return _encoded(id_and_text(docs, id_col, text_col), rank_file, pattern, False)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`encode` and, in the same pass, ``decoded``: the bytes of the ids."""
    return _encoded(id_and_text(docs, id_col, text_col), rank_file, pattern, True)


def decode(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``tokens(doc_id, n_tokens, ids)`` with ``decoded``, the bytes of the ids in
    order. Ids cut anywhere give the bytes of just these ids, which need not be
    whole characters. Null ids are no ids. An id that the file lacks is an error.
    """
    def run(batches):
        tables = _tables(rank_file, pattern)
        for batch in batches:
            for part, ids in pieces(batch, "ids", SLICE_BYTES):
                decoded = pa.array(tables.decode([x or b"" for x in ids]), pa.binary())
                yield pa.record_batch([*part.columns, decoded], names=_names(_DECODED))
    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, _DECODED)
