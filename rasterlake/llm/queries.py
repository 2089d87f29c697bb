"""The driver's queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, line_dedup, near_dedup, pieces, quality, suffix_dedup, token_shards, topk, toxicity, warc
from .common import fold_of


def tokenizer(name: str) -> str:
    """The path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(_table(spark, sf_dir, "documents"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_report(_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup_report(_table(spark, sf_dir, "documents"), percent=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels)
    return _held_out(toxicity.score(docs.select("doc_id", "text"), model, keep=["doc_id"]))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoder = token_shards.Encoder.load(tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_shards.round_trip(_table(spark, sf_dir, "documents"), encoder)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    found = decontam.find_hits(docs, benchmark, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(docs, tokenizer("piece_bpe_32k.model"), keep=["doc_id"])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels)
    return _held_out(quality.score(docs.select("doc_id", "text"), model, keep=["doc_id"]))


def _held_out(scored: DataFrame) -> DataFrame:
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_near_dedup, op3_toxicity, op4_token_shards, op5_decontamination, op6_sentencepiece, op7_quality, op8_line_dedup, op9_topk, op10_warc)}

ORACLE_SQL = {
    "op1_suffix_dedup": suffix_dedup.ORACLE,
    "op2_near_dedup": near_dedup.ORACLE,
    "op5_decontamination": decontam.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_topk": topk.ORACLE,
    "op10_warc": warc.ORACLE,
}
