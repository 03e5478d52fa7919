"""Each stage's decisions against its operator and plain Python, on whole tables."""

import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import pytest

from gearsight.llm import decontam, lm, simhash, toxicity  # noqa: F401
from gearsight.llm.common import table
from test_llm_lines import plain as plain_lines
from test_llm_simhash import plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = (before, docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity(spark, stages):
    before, after = map(texts, stages["toxicity"])
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    train = [(before[d], y) for d, y in sorted(labels.items()) if d in before and zlib.crc32(str(d).encode()) % 5]
    lexicon = toxicity.fit_lexicon(train)
    assert after == {d: t for d, t in before.items() if lexicon.score(t) < 0.5}


def test_lines(stages):
    before, after = map(texts, stages["line_dedup"])
    assert after == {d: t for d, t, _, _ in plain_lines(list(before.items()), 10)}
    assert after != before
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"][1].collect())


def test_simhash(stages):
    before, after = map(texts, stages["simhash"])
    groups = plain_groups([(d, plain_fingerprint(t)) for d, t in before.items()])
    assert set(after) == {c for _, _, c in groups} and len(after) < len(before)


def test_leaks(spark, stages):
    before, after = map(texts, stages["decontamination"])
    items = [" ".join(x.decode() for x in decontam.words_of(r.text)) for r in table(spark, SF, "benchmark").collect()]
    clean = {d: " ".join(x.decode() for x in decontam.words_of(t)) for d, t in before.items()}
    whole = {d for d, t in clean.items() if any(i in t for i in items)}
    assert whole and not whole & set(after)
    # what stays shares less than half of any item's words in order; what goes shares a good part
    for d in set(before) - set(after) - whole:
        assert max(len(set(clean[d].split()) & set(i.split())) / len(set(i.split())) for i in items) >= 0.5


def test_packing(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in after.collect()} == set(texts(before))


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(got.select(*cols).collect()) == Counter(stages["packing"][1].select(*cols).collect())


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def as_table(spark, rows, folder):
    """A documents table of (id, text) rows, beside the other small tables."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    df.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        table(spark, SF, t).write.parquet(f"{folder}/{t}.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


A, B, C = ("one two three four five six seven", "quite another text of some more words here", "a third text that stands for itself")


def test_near_duplicates_by_row(spark, tmp_path):
    """Null, repeated and clashing ids: one row of each text stays, and no other goes."""
    docs = as_table(spark, [(3, A), (7, A), (7, B), (9, C), (9, C), (None, A), (None, B), (None, None), (1, "")], tmp_path)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted([A, B, C, ""])


def test_leaks_by_row(spark, tmp_path):
    leak = table(spark, SF, "benchmark").first().text
    docs = as_table(spark, [(3, A), (3, "so " + leak), (None, leak), (None, B), (5, leak), (5, leak), (None, None)], tmp_path)
    kept = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(3, A), (0, B), (0, "")])


def test_run_on_odd_rows(spark, tmp_path):
    docs = [(3, A), (7, A), (7, B), (None, C), (None, C), (8, None), (8, ""), (9, "long " * 30_000)]
    as_table(spark, docs, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sums = Counter()
    for r in got:
        sums[r.sequence_id] += r.length
    assert max(sums.values()) <= 1024 and {r.doc_id for r in got} >= {7, None, 9}
    assert len({(r.start, r.ids_crc32) for r in got if r.piece == 0}) == 5      # A, B, C, the long and the empty text


def test_run_on_an_empty_table(spark, tmp_path):
    as_table(spark, [], tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_sql_oracles(spark):
    """The SQL queries on the small tables (the driver compares larger ones)."""
    from gearsight.llm.queries import oracle_sql, queries
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, SF)
        rel = con.sql(sql)
        order = [rel.columns.index(c) for c in df.columns]
        assert Counter(tuple(r) for r in df.collect()) == Counter(tuple(r[i] for i in order) for r in rel.fetchall())
