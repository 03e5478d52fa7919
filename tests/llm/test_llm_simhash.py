"""SimHash groups and components against brute force."""

import random

import pytest
import xxhash

from gearsight.llm import simhash
from gearsight.llm.components import components
from helpers import MESSY, docs_frame, words


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(pairs):
    """Smallest id per group of (id, fingerprint) rows linked at <= 2 bits."""
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(pairs)):
        for j in range(i):
            if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(pairs)), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [words(rng, 60) for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(["New", "edit", "lun"])
            rows.append((len(rows), " ".join(w)))
    return rows + [(1000 + i if i is not None else None, t) for i, t in MESSY]


@pytest.mark.parametrize("dense", [256, 2])
def test_groups(spark, corpus, dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE_BUCKET", dense)
    got = simhash.near_duplicates(docs_frame(spark, corpus)).collect()
    want = plain_groups([(d, plain_fingerprint(t)) for d, t in corpus])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert len({c for _, _, c in want}) < len(want)


def test_links_near_each_other(spark):
    """Random fingerprints with all bit pairs flipped: every pair is found."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64)}
    for f in list(fps):
        fps |= {f ^ (1 << a) ^ (1 << b) for a in range(0, 64, 7) for b in range(0, 64, 9)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    got = {(min(r), max(r)) for r in simhash.links(df, 2).collect()}
    flat = list(signed)
    want = {(i, j) for j in range(len(flat)) for i in range(j)
            if bin((flat[i] ^ flat[j]) & (1 << 64) - 1).count("1") <= 2}
    assert got == want


def test_empty(spark):
    assert simhash.near_duplicates(docs_frame(spark, [])).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(
        edges + [(1, 1), (None, 2)], "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: label[x] for a, b in edges if a != b for x in (a, b)}
