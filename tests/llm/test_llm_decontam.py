"""Planted benchmark passages are found; other texts are left alone."""

import random

import numpy as np

from gearsight.llm import decontam
from helpers import MESSY, docs_frame, words

ITEMS = "item_id long, text string, doc_id long, score double, h int"


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 7, 0.5, 1) for i, t in items], ITEMS)


def plain_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_align():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 15))] for _ in range(2))
        assert decontam.align(np.array(a), np.array(b))[0] == plain_align(a, b)


def test_planted(spark):
    rng = random.Random(6)
    many = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ala", "ero", "ini", "osu", "ulte", "ynd", "arc", "esk")]
    items = [(i, " ".join(words(rng, rng.randint(15, 45), many))) for i in range(30)]
    rows, want = [], set()
    for d in range(120):
        body = words(rng, 200, many)
        if d % 3 == 0:
            i, text = items[d % 30]
            w = text.split()
            if d % 2:                                   # edited: every seventh word
                w = [rng.choice(many) if k % 7 == 3 else x for k, x in enumerate(w)]
            if d % 4 == 0:
                w = [x.upper() + "," for x in w]
            body[90:90] = w
            want.add((d, i))
        rows.append((d, " ".join(body)))
    rows += [(200 + d, items[5][1]) for d in range(60)]            # one item leaked into a third of the rows
    want |= {(200 + d, 5) for d in range(60)}
    rows += [(None if i is None else 900 + i, t) for i, t in MESSY] + [(960, items[7][1]), (960, items[7][1])]
    want.add((960, 7))
    extra = [(50, None), (51, ""), (52, "zig zag"), (None, "no id at all"), (53, items[0][1]), (53, items[0][1])]
    rows.append((970, "zig zag"))
    want.add((970, 52))
    want |= {(d, 53) for d, i in want if i == 0}
    got = decontam.contaminated(docs_frame(spark, rows), items_frame(spark, items + extra)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(0.5 <= r.score <= 1 for r in got)


def test_edited_beside_exact(spark):
    """The seeds an edited copy keeps are the item's most frequent ones."""
    item = [f"w{i}" for i in range(30)]
    kept = {0, 1, 2} | {i for i in range(4, 30) if i % 3}           # one run of three, then pairs: a single seed
    rows = [(1, "before " + " ".join(item) + " behind")]
    rows += [(d, " ".join("x" if k % n == n - 1 else w for k, w in enumerate(item))) for d, n in ((2, 5), (3, 6))]
    rows += [(4, " ".join(w if k in kept else "x" for k, w in enumerate(item)))]
    rows += [(10 + d, f"w0 w1 w2 then other words {d}") for d in range(20)]       # the phrase alone is no leak
    got = decontam.contaminated(docs_frame(spark, rows), items_frame(spark, [(7, " ".join(item))])).collect()
    share = {d: plain_align(item, t.split()) / 60 for d, t in rows}
    assert {d for d, x in share.items() if x >= 0.5} == {1, 2, 3, 4}
    assert {r.doc_id: r.score for r in got} == {d: share[d] for d in (1, 2, 3, 4)} and len(got) == 4


def test_all_pairs(spark):
    """Against every (document, item) pair: openings that many items share, edited
    copies of which only the opening is whole, short, equal and clashing items."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(150)]
    opening = [f"o{i}" for i in range(6)]
    items = [(i, " ".join((opening if i % 2 else []) + rng.choices(vocabulary, k=rng.randint(4, 30)))) for i in range(40)]
    items += [(40, "o0 o1"), (41, "o2"), (42, items[1][1]), (1, "quite another text of one id"), (43, "o1 o2 o3 o4")]
    rows = []
    for d in range(150):
        body = rng.choices(vocabulary, k=rng.randint(5, 60))
        if d % 2:
            w = items[rng.randrange(40)][1].split()
            body[3:3] = w[:6] + [rng.choice(vocabulary) if k % rng.choice((2, 3, 5)) == 1 else x
                                 for k, x in enumerate(w[6:])]
        elif d % 3:
            body[2:2] = opening
        rows.append((d, " ".join(body)))
    want = {}
    for d, t in rows:
        doc = decontam.Passages(t, 3)
        for i, text in items:
            share, end = doc.best(decontam.words_of(text), 0.5)
            if share >= 0.5:
                want[d, i] = max(want.get((d, i), (0, 0)), (share, end))
    got = decontam.contaminated(docs_frame(spark, rows), items_frame(spark, items)).collect()
    assert len(want) > 100 and {(r.doc_id, r.item_id): (r.score, r.end_word) for r in got} == want and len(got) == len(want)


def test_common_opening_makes_no_pairs(spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(2_000)]
    text = lambda k: "in this text you will find " + " ".join(rng.choices(vocabulary, k=k))
    items, rows = [(i, text(25)) for i in range(100)], [(d, text(100)) for d in range(1_000)]
    rows[17] = (17, "x " + items[3][1])
    one = spark.createDataFrame(items, "item long, text string")
    pairs = {(r.doc_id, r.item) for r in decontam.candidates(docs_frame(spark, rows).select("doc_id", "text"), one).collect()}
    assert (17, 3) in pairs and len(pairs) < len(rows)              # of 100,000


def test_most_matches_bounds_alignments():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (np.array([rng.randrange(lo, 6) for _ in range(rng.randint(1, 15))]) for lo in (0, -1))
        assert decontam.align(a, b)[0] <= 2 * decontam.most_matches(a, b)


def test_empty(spark):
    one = [(1, "some words of an item")]
    assert decontam.contaminated(docs_frame(spark, []), items_frame(spark, one)).collect() == []
    assert decontam.contaminated(docs_frame(spark, one), items_frame(spark, [])).collect() == []
