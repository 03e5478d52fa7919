"""Byte-level BPE against the tiktoken library, and the exact round trip."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN, path

import __spark_entry__ as E
from gearsight.llm import byte_bpe
from helpers import MESSY, docs_frame

RANKS = path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def _odd(rng):
    letters = "abcdeéñßдж中文あ한🙂́‍ \n\t\r\x0b\x1c\x85 　'.,-0123٣"
    yield from ("a" * 5000, "ab" * 999, "aab" * 500, "na" * 333 + "ana", "\n" * 300, " " * 301 + "x", "\0a\0", "'s 'll it's I'LL",
                "<|endoftext|> a", "x" * 7 + "é" * 400, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2500)))
    for _ in range(300):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))


def test_encode_and_decode(spark, plain):
    rows = MESSY + [(100 + i, t) for i, t in enumerate(_odd(random.Random(3)))]
    encoded = byte_bpe.encode(docs_frame(spark, rows), RANKS, PATTERN)
    got = byte_bpe.decode(encoded, RANKS, PATTERN).collect()
    assert sorted(map(str, got)) == sorted(map(str, byte_bpe.round_trip(docs_frame(spark, rows), RANKS, PATTERN).collect()))
    want = [(i, plain.encode_ordinary(t or "")) for i, t in rows]
    assert (sorted((str(r.doc_id), r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got)
            == sorted((str(i), len(ids), ids, plain.decode_bytes(ids)) for i, ids in want))


def test_small_cache_and_slices(spark, plain, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    monkeypatch.setattr(byte_bpe, "ROUNDS", 3)
    tables = byte_bpe.Tables(RANKS, PATTERN)
    for text in _odd(random.Random(5)):
        assert np.frombuffer(tables.encode([text, ""])[0], "<u4").tolist() == plain.encode_ordinary(text)


def test_every_word_of_the_tables(plain, spark):
    """Merging alone, without the short way for whole tokens, on real words."""
    words = {w for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for w in (r.text or "").split()}
    words = sorted(w.encode() for w in words)
    got = byte_bpe.Tables(RANKS, PATTERN).merged(words)
    for word, ids in zip(words, got):
        if word not in plain._mergeable_ranks:
            assert np.frombuffer(ids, "<u4").tolist() == plain._core_bpe.encode_single_piece(word)


def test_decode_parts_of_characters_and_unknown_ids(plain):
    tables = byte_bpe.Tables(RANKS, PATTERN)
    ids = plain.encode_ordinary("中文 🙂")
    parts = [np.array([i], "<u4").tobytes() for i in ids]
    assert b"".join(tables.decode(parts)) == "中文 🙂".encode()
    assert tables.decode([b"", b""]) == [b"", b""] and tables.decode([]) == []
    with pytest.raises(ValueError):
        tables.decode([np.array([50_256], "<u4").tobytes()])


def test_empty_table(spark):
    encoded = byte_bpe.encode(docs_frame(spark, []), RANKS, PATTERN)
    assert byte_bpe.decode(encoded, RANKS, PATTERN).collect() == []


def test_a_file_without_all_bytes(tmp_path):
    (tmp_path / "few").write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(tmp_path / "few"))


def test_query(spark, plain):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in E.queries()["op11_byte_bpe"](spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = plain.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want
