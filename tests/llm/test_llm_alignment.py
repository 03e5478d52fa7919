"""Cross-tokenizer alignment against nested loops over plain tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

import __spark_entry__ as E
from gearsight.llm import token_alignment as T
from helpers import MESSY, docs_frame

FILES = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in shown}
    chars |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def tokens(text):
        if not text:
            return [], []
        of_a = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        of_b = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            of_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        want = b" " + text.encode()
        ok = all(b"".join(x for _, x in side) == want for side in (of_a, of_b))
        return (of_a, of_b) if ok else ([], [])
    return tokens


def spans(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(rows, tokens):
    found = []
    for i, text in rows:
        a, b = map(spans, tokens(text))
        links, low = [], 0
        for x, s, e in a:
            while low < len(b) and b[low][2] <= s:
                low += 1
            j = low
            while j < len(b) and b[j][1] < e:
                links.append((x, b[j][0]))
                j += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for cut in cuts:
            inside = [[str(x) for x, s, e in side if start <= s and e <= cut] for side in (a, b)] if len(a) < 2000 else None
            groups.append(inside and "|".join(map(",".join, inside)))
            start = cut
        found.append((i, a, b, links, groups))
    docs = Counter(p for *_, links, _ in found for p in set(links))
    top = defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    return sorted(((i, len(a), len(b), len(g), len(k), sum(docs[p] == top[p[0]] for p in k), sum(docs[p] for p in k),
                    "" if not a else None if g[0] is None else hashlib.sha256(";".join(g).encode()).hexdigest())
                   for i, a, b, k, g in found), key=str)


def same(got, want):
    got = sorted(map(tuple, got), key=str)
    want = [w if w[-1] is not None else (*w[:-1], g[-1]) for g, w in zip(got, want)]
    assert got == want


ODD = ["<|endoftext|> a", "<s> </s> <unk> <0x41>", "a ▁ b", "▁", "two  spaces", "\ttab\r\n x", " lead", "trail ", "\n", "\na\nb",
       "nul\0 x", "ééé ñandú 中文テキスト 한국어", "🙂👩‍👩‍👧 é ​", "don't they'll", "x" * 500, "1234567 89,10.", "﻿bom", "ﬁ ²"]


@pytest.mark.parametrize("most", [T.FREQUENT, 40, 0])
def test_against_loops(spark, sides, most, monkeypatch, tmp_path):
    rng = random.Random(2)
    rows = MESSY + list(enumerate(ODD, 100)) + [(200 + i, " ".join(rng.choices(ODD + ["the", "cat", "sat."], k=6))) for i in range(40)]
    aligned = T.align(docs_frame(spark, rows).repartition(3), *FILES)
    aligned = aligned.withColumn("groups_sha256", T.F.when(T.F.col("n_a") > 0, T.F.sha2("groups", 256)).otherwise(""))
    got = T.link_counts(aligned.drop("groups"), *T.vocabulary_sizes(*FILES), most=most)
    same(got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect(),
         plain(rows, sides))


def test_given_documents(spark, sides):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(E.queries()["op13_alignment"](spark, SF).collect(), plain(rows, sides))


def test_words_alone_as_whole_texts(spark, monkeypatch):
    """Ids kept by word are those of the whole text."""
    encoders = T.Encoders(*FILES)
    monkeypatch.setattr(T, "CACHE", 50)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        got, want = encoders.encode([r.text or ""])[0], encoders._whole(r.text) if r.text else (b"", b"")
        assert [x.tobytes() for x in got] == list(want)


def test_empty_table(spark):
    aligned = T.align(docs_frame(spark, []), *FILES).drop("groups")
    assert T.link_counts(aligned, *T.vocabulary_sizes(*FILES)).collect() == []
