"""Induced sorting and repeat removal against brute force."""

import hashlib
import os
import random
import tempfile
import uuid

import numpy as np
import pytest

from gearsight.llm import induced_sort, suffix_dedup
from helpers import MESSY, docs_frame


def plain_order(t, cap):
    s = [tuple(t[i:]) for i in range(len(t))]
    order = sorted(range(len(t)), key=s.__getitem__)
    common = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < min(cap, len(t) - max(a, b)) and t[a + k] == t[b + k]:
            k += 1
        common.append(k)
    return order, common, s


@pytest.mark.parametrize("memory", [0, 1 << 20])
@pytest.mark.parametrize("recurse", [1, 64])
def test_suffix_order(memory, recurse, monkeypatch):
    monkeypatch.setattr(induced_sort, "RECURSE", recurse)
    rng = np.random.default_rng(memory + recurse)
    for turn in range(250):
        n = int(rng.integers(0, 70))
        t = rng.integers(1, int(rng.integers(2, 6)), n)
        if turn % 3 == 0 and n:
            t = np.tile(t[:max(1, n // 4)], 6)[:n]
        t = np.append(t, 0)
        cap = int(rng.choice([4, 1000]))
        order, common = induced_sort.suffix_order(t, cap, memory)
        want, lengths, s = plain_order(t.tolist(), cap)
        assert common.tolist() == lengths
        assert [s[i][:cap] for i in order] == [s[i][:cap] for i in want] and sorted(order) == sorted(want)


def plain_removed(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for i, b in enumerate(texts):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s:s + length], []).append((i, s))
    gone = [np.zeros(len(b), bool) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s:s + length] = True
    out = []
    for (d, _), b, g in zip(rows, texts, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], g.astype(int)])) == 1))
        out.append((d, len(b), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_with_repeats(seed):
    rng = random.Random(seed)
    letter = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    shared = [letter(rng.randint(20, 60)) for _ in range(4)]
    rows = [(i, letter(rng.randint(0, 50)) + rng.choice(shared)[rng.randint(0, 8):] + letter(rng.randint(0, 40)))
            for i in range(60)]
    return rows + [(100, "ab" * 60), (101, "a" * 90), (102, rows[3][1]), (103, rows[3][1])] + [
        (None if i is None else 1000 + i, t[:3000] if t else t) for i, t in MESSY]


@pytest.mark.parametrize("hot", [16 << 20, 0])
def test_removal(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    rows = rows_with_repeats(2)
    got = suffix_dedup.remove_repeats(docs_frame(spark, rows), length=18, anchor=5)
    want = plain_removed(rows, 18)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == want
    assert any(w[2] for w in want) and any(not w[2] for w in want)


@pytest.mark.parametrize("rounds", [1, 3])
def test_hot_anchor_lots_are_bounded(spark, rounds, monkeypatch):
    """One passage in many surroundings and a text of one letter: no lot that a
    task sorts exceeds twice HOT_BYTES, and all repeats are found."""
    most, notes = 3000, tempfile.mkdtemp(prefix="run-", dir="/tmp")
    plain = suffix_dedup.repeated_windows

    def noted(contents, length, *rest):
        with open(f"{notes}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(sum(map(len, contents))))
        return plain(contents, length, *rest)
    monkeypatch.setattr(suffix_dedup, "repeated_windows", noted)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", most)
    monkeypatch.setattr(suffix_dedup, "ROUNDS", rounds, raising=False)
    rng = random.Random(4)
    letter = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letter(24)
    rows = [(i, letter(60) + passage + letter(60)) for i in range(400)] + [(500, "x" * 9000), (501, "yz" * 4000)]
    rows += [(600 + i, letter(9) + rows[i][1][20:110] + letter(9)) for i in range(0, 60, 3)]
    docs = docs_frame(spark, rows).repartition(3)
    got = suffix_dedup.remove_repeats(docs, length=40, anchor=8)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == plain_removed(rows, 40)
    lots = [int(open(f"{notes}/{x}").read()) for x in os.listdir(notes)]
    assert lots and max(lots) <= 2 * most


def test_full_length(spark):
    rng = random.Random(9)
    letter = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    passage, long = letter(900), letter(399)
    rows = [(1, letter(500) + passage + letter(300)), (2, passage[100:620]), (3, letter(2000)), (4, "x" * 3000),
            (5, long), (6, long), (7, letter(100) + passage[:450] + letter(50) + passage[:450])]
    got = suffix_dedup.remove_repeats(docs_frame(spark, rows))
    assert sorted(tuple(r)[:5] for r in got.collect()) == plain_removed(rows, 400)


def test_empty(spark):
    assert suffix_dedup.remove_repeats(docs_frame(spark, [])).collect() == []
