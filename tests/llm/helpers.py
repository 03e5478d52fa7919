"""Small inputs shared by the tests of this folder."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, k int, h long, t string, score int"


def docs_frame(spark, rows):
    """``rows`` of (id, text) with the other columns of documents and columns whose
    names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, 1, 2, 3, "t", 4) for i, t in rows], DOCS)


def words(rng: random.Random, n: int, vocabulary=None) -> list[str]:
    vocabulary = vocabulary or ["ba", "ko", "miri", "tosa", "the", "of", "lun", "gra", "pel", "vint", "sor", "ade"]
    return [rng.choice(vocabulary) + rng.choice(["", "x", "ing", "o"]) for _ in range(n)]


MESSY = [(1, None), (2, ""), (3, "  \t\n "), (None, "a null id here"), (None, None), (4, "One"), (4, "One"),
         (5, "é ñ — “quoted”   text\x0b with odd\r\nspaces"), (6, "word " * 40_000), (7, "tie"), (8, "tie")]
