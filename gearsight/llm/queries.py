"""The package's queries: one per operator, and the pipeline of the repository."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.llm import (
    ann, byte_bpe, decontam, line_dedup, lm, merkle, packing, quality, simhash, suffix_dedup, token_alignment, toxicity,
    url_filter)
from gearsight.llm.common import fold, table
from gearsight.llm.oracles import ORACLES
from gearsight.llm.url_filter import LOWER, UPPER
from gearsight.session import apply_defaults

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where an installed public vocabulary lies; the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, keep_bytes=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.language_model(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), cap=1024, end_id=2)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN
    back = byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(RANKS), PATTERN)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plain = ["doc_id", "source", "lang", "n_chars"]
    lowered = F.translate("text", UPPER, LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaf = merkle.leaf([F.col(c) for c in [*plain, "text"]])
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"),
                         F.when(tampered, merkle.leaf([*map(F.col, plain), lowered])).otherwise(leaf).alias("shown"))
    proven = merkle.manifest(leaves, ["doc_id"], "lang").withColumn("folded_root", merkle.folded(F.col("shown"), F.col("path")))
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenizer_path(), tokenizer_path(PIECES)
    aligned = token_alignment.align(table(spark, sf_dir, "documents"), *files)
    hashed = aligned.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    return token_alignment.link_counts(hashed, *token_alignment.vocabulary_sizes(*files)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = (op1_simhash, op2_suffix_dedup, op3_decontamination, op4_url_filter, op5_nearest, op6_quality, op7_toxicity,
            op8_line_dedup, op9_language_model, op10_packing, op11_byte_bpe, op12_merkle, op13_alignment)


def _prepared(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_defaults(spark)
        return build(spark, sf_dir)
    return run


def queries() -> dict:
    found = _QUERIES + ((pipeline,) if importlib.util.find_spec("corpus_pipeline") else ())
    return {q.__name__: _prepared(q) for q in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
