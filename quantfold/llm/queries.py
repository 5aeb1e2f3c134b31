"""Queries of the training-data operators and their DuckDB oracles.

Every query reads its whole table with production parameters; the contract's
digest columns are derived from the operators' results here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, lang_id, license_scan, line_dedup, lm, ngram_join, oracles, quality, sharding, token_align, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> bpe.Bpe:
    """The public 50k byte-level vocabulary."""
    import public_tokenizers as public
    return bpe.Bpe(bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = lang_id.held_out(F.col("doc_id"))
    model = lang_id.fit(docs.filter(~out))
    named = lang_id.predict(docs.select("doc_id", "text"), model)
    return named.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=85)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokenizer()
    coded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, digest="ids_sha256")
    back = bpe.decode(coded.select("doc_id", "ids", "ids_sha256"), vocabulary)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256",
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines_removed", "text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(license_scan.TEMPLATES, "license_id string, text string")
    return license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), templates)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (fold != 2).alias("learn"))
    return lm.score(docs).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                                 "train_tokens", "base_score", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
                        F.size("near_items").cast("long").alias("n_near_items"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = toxicity.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), ~out)
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32)
    return found.select("vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened",
                        "explained", "identity_error")


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public.path("piece_bpe_32k.model"), "rb") as b:
        return token_align.align(_table(spark, sf_dir, "documents"), a.read(), b.read())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_ngram_jaccard, op3_byte_bpe, op4_chat_format, op5_line_dedup,
                            op6_quality_rules, op7_license_scan, op8_sharding, op9_lm_score, op10_decontamination, op11_toxicity, op12_whitening,
                            op13_token_align)}

ORACLES: dict[str, str] = {"op4_chat_format": oracles.CHAT, "op6_quality_rules": oracles.QUALITY,
                           "op10_decontamination": oracles.DECONTAM}
