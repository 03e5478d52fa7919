"""Merkle manifest against plain Python and SQL."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest

import __spark_entry__ as E
from gearsight.llm import merkle
from helpers import MESSY, docs_frame

SF = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, **other):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in ({**row, **other}[f] for f in FIELDS)))


def plain_tree(leaves, fanout=8):
    """The root, and for each leaf its siblings before and behind it, level by level."""
    paths, nodes, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for i, p in enumerate(at):
            run = runs[p // fanout]
            paths[i].append(("".join(run[:p % fanout]), "".join(run[p % fanout + 1:])))
        nodes, at = ["".join([H(*r)]) for r in runs], [p // fanout for p in at]
    return nodes[0], paths


def plain(rows, fanout=8):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r, plain_leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        inner[g] = plain_tree([h for _, h in groups[g]], fanout)
    root, above = plain_tree([inner[g][0] for g in names], fanout) if names else (None, [])
    out = []
    for g, high in zip(names, above):
        for (r, h), path in zip(groups[g], inner[g][1]):
            path = path + high
            shown = h
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
                shown = plain_leaf(r, text=low)
            node = shown
            for before, behind in path:
                node = H(before, node, behind)
            out.append((r["doc_id"], h, inner[g][0], root, H(*(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def query(spark, rows, tmp_path):
    docs = docs_frame(spark, [])
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) + (1, 2, 3, "t", 4)
                                   for r in rows], docs.schema) if rows else docs
    frame.repartition(5).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, E.queries()["op12_merkle"](spark, str(tmp_path)).collect()), key=str)


def _rows(rng, n, langs):
    return [{"doc_id": i, "text": rng.choice(["Abc", "abc", None, "", "ÄB é", "x" * rng.randint(0, 9)]),
             "lang": rng.choice(langs), "source": rng.choice(["s", None, "1:a"]), "n_chars": rng.choice([None, 3, -1])}
            for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (8, ["en"]), (9, ["en", None]), (65, ["a", "B", "é"]), (600, ["en", None, ""]),
                                      (120, [f"l{i}" for i in range(70)] + [None])])
def test_query_against_plain_python(spark, tmp_path, n, langs):
    rows = _rows(random.Random(n), n, langs)
    assert query(spark, rows, tmp_path) == plain(rows)


def test_messy_rows(spark, tmp_path):
    base = {"lang": "en", "source": "s", "n_chars": 1}
    rows = [{"doc_id": i, "text": t, **base} for i, t in MESSY] + 30 * [{"doc_id": None, "text": "Copy", **base, "lang": None}]
    got = query(spark, rows, tmp_path)
    assert got == plain(rows)
    assert {g[0] for g in got if not g[-1]} <= {i for i, _ in MESSY}     # what is shown unchanged verifies


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


@pytest.mark.parametrize("fanout", [2, 3])
def test_other_fanout_group_and_order(spark, fanout):
    rows = [(f"k{i % 37:02d}", i % 3, H(str(i))) for i in range(100)]
    df = spark.createDataFrame(rows, "name string, part int, leaf string")
    got = merkle.manifest(df, ["name"], "part", fanout).withColumn("back", merkle.folded(merkle.F.col("leaf"), merkle.F.col("path"))).collect()
    subroots = [plain_tree([h for _, _, h in sorted(r for r in rows if r[1] == p)], fanout)[0] for p in range(3)]
    assert {(r.part, r.subroot) for r in got} == set(enumerate(subroots))
    assert {r.root for r in got} == {r.back for r in got} == {plain_tree(subroots, fanout)[0]}
    assert sorted((r.name, r.part, r.leaf) for r in got) == sorted(rows)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{SF}/documents.parquet'")
    want = con.execute(E.oracle_sql()["op12_merkle"])
    names = [d[0] for d in want.description]
    got = E.queries()["op12_merkle"](spark, SF).cache()
    assert sorted(map(str, got.select(names).collect())) == sorted(
        str(spark_row) for spark_row in (got.select(names).collect()[0].__class__(*names)(*r) for r in want.fetchall()))
    assert {r.verified for r in got.collect()} == {True, False}
