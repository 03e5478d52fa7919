"""Token pieces against the tokenizer, plans against counts and the bound."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gearsight.llm import packing
from gearsight.llm.queries import tokenizer_path
from helpers import MESSY, docs_frame, words

ODD = ["a  b", "\n\na", "a \n b", "\tq", "x y z", "<|endoftext|> a", "a\r\nb", " lead", "trail ", "é ñ x",
       "don't we'll 's", "x, y. z.. ,.", "a1 b² ½ ⅷ", "é.", ".", "\n", "a\0b c", "ß, ñ. 中文 字,", "x\x1cy z"]


def test_word_cache_equals_tokenizer(monkeypatch):
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    monkeypatch.setattr(packing, "CACHE", 50)
    tok, rng = packing.WordCachedTokenizer(tokenizer_path()), random.Random(1)
    for t in ODD + [" ".join(words(rng, 80)) + ".\n" + ", ".join(words(rng, 9)) for _ in range(40)]:
        assert tok.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_pack(spark):
    rng, plain = random.Random(2), Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    rows = [(i, " ".join(words(rng, rng.choice([3, 30, 200, 420, 900])))) for i in range(150)]
    rows += [(None if i is None else 1000 + i, t) for i, t in MESSY] + [(2000 + i, t) for i, t in enumerate(ODD)]
    cap = 256
    got = packing.pack(docs_frame(spark, rows), tokenizer_path(), cap=cap, keep_ids=True).collect()
    want = Counter()
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % cap or min(cap, len(ids))
        edges = [0, *range(first, len(ids) + 1, cap)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.02 * max(-(-total // cap), sum(r.length > cap // 2 for r in got)) + 1


def test_empty(spark):
    assert packing.pack(docs_frame(spark, []), tokenizer_path()).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = random.Random(seed)
    cap = rng.choice([16, 100, 1024])
    counts = {x: rng.choice([1, 3, 1000, 10 ** 6]) for x in rng.sample(range(1, cap + 1), rng.randint(1, min(cap, 60)))}
    runs = packing.plan(counts, cap)
    placed, ranks = Counter(), defaultdict(list)
    for r in runs:
        assert 0 < sum(x for x, _ in r.slots) <= cap and r.n > 0
        for x, first in r.slots:
            placed[x] += r.n
            ranks[x].append((first, first + r.n))
    assert placed == counts
    for x, spans in ranks.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == counts[x]


def test_plan_rejects_other_lengths():
    assert packing.plan({}, 10) == []
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)
