"""Line dedup and its perfect hash against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gearsight.llm import line_dedup
from helpers import MESSY, docs_frame, words


def plain(rows, least):
    def key(x):
        x = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    docs = [(t or "").split("\n") for _, t in rows]
    n = Counter(k for d in docs for k in {key(x) for x in d} if k)
    out = []
    for (i, _), d in zip(rows, docs):
        kept = [x for x in d if n[key(x)] < least]
        out.append((i, "\n".join(kept), len(d), len(d) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_keys, probes, hot", [(1 << 18, 40, 1 << 12), (20, 40, 1 << 12), (1 << 18, 1 << 20, 1), (20, 2, 30)])
def test_lines(spark, shard_keys, probes, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(line_dedup, "PROBES", probes)
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(4)
    pool = [" ".join(words(rng, 3)) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str])(rng.choice(pool))
                          + rng.choice(["", "  \r"]) for _ in range(rng.randint(1, 8)))) for i in range(80)]
    rows += [(None if i is None else 500 + i, t) for i, t in MESSY] + [(600 + i, "\n\nSame Line \n") for i in range(12)]
    got = line_dedup.drop_common_lines(docs_frame(spark, rows), min_docs=10)
    want = plain(rows, 10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert any(w[3] for w in want)


def test_one_line_in_all_documents_and_many_null_ids(spark):
    """The common line and the copies are dealt out, ids or not."""
    rng = random.Random(7)
    rows = [(None if i % 2 else 5, "Common Line\n" + " ".join(words(rng, 4)) + "\nshared by some" * (i % 50 == 0))
            for i in range(3000)] + [(None, "common line\ncopy")] * 1500
    docs = docs_frame(spark, rows)
    got = line_dedup.drop_common_lines(docs, min_docs=10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 10)
    texts = sorted(r.text for r in line_dedup.without_common_lines(docs, min_docs=10).collect())
    assert texts == sorted(x[1] for x in plain(rows, 10))
    lists = line_dedup._hash_lists(line_dedup._by_text(docs, "text").select("_line_key", "text"))
    counts = line_dedup._counted(lists).toPandas()
    assert (counts["n"] * line_dedup.HOT >= counts["n"].sum()).sum() <= line_dedup.HOT


def test_empty(spark):
    assert line_dedup.drop_common_lines(docs_frame(spark, [])).collect() == []


@pytest.mark.parametrize("most", [10, 1000])
def test_index(most, monkeypatch):
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    counts = rng.integers(1, 2000, len(keys))
    index = line_dedup.open_index(line_dedup.build_index(keys, counts, most))
    assert (line_dedup.probe(index, keys) == np.minimum(counts, most)).all()
    other = rng.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    assert (line_dedup.probe(index, other) > 0).mean() < 0.001      # fingerprints tell strangers
    exact = line_dedup.open_index(line_dedup.build_index(keys[:4096], counts[:4096], most, exact=True))
    assert (line_dedup.probe(exact, keys[:4096]) == np.minimum(counts[:4096], most)).all()
    strangers = np.concatenate([rng.integers(0, 1 << 63, (500_000, 2)).astype(np.uint64), keys[4096:]])
    assert not line_dedup.probe(exact, strangers).any()
    monkeypatch.setattr(line_dedup, "_LEVELS", 1)                   # most keys in the sorted rest
    index = line_dedup.open_index(line_dedup.build_index(keys[:500], counts[:500], most))
    assert (line_dedup.probe(index, keys[:500]) == np.minimum(counts[:500], most)).all()
