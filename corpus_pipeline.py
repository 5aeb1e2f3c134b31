"""Corpus pipeline: language ID, line dedup, near duplicates, decontamination, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``; a
stage works on every row its predecessor kept, and its decisions take effect:

1. ``language_id`` learns from the labelled rows and drops documents that it
   rejects (no letters, or too far from every language).
2. ``line_dedup`` cuts repeated passages out of the texts (``n_chars``
   follows) and drops documents that consisted of nothing else.
3. ``near_duplicates`` keeps the smallest doc_id of every group of documents
   linked by five-word shingles at a Jaccard similarity of 0.8.
4. ``decontaminate`` drops documents that hold a benchmark phrase of ten words.
5. ``bpe`` encodes the texts and decodes the ids again: doc_id, lang, source,
   n_tokens, ids, and the digests of ids and decoded bytes.

Null texts are rejected by the first stage; other edge cases are those of the
operators. Extra columns of ``documents`` are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantfold.llm import bpe, decontam, lang_id, line_dedup, ngram_join
from quantfold.llm._common import stored
from quantfold.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = lang_id.predict(docs, lang_id.fit(docs))
    return named.filter("NOT rejected").select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(docs, drop_emptied=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = tokenizer()
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary, digest="ids_sha256")
    back = bpe.decode(coded.select("doc_id", "lang", "source", "ids", "ids_sha256"), vocabulary)
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "ids_sha256",
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("bpe", bpe_stage),
]

#: Language ID, chunking and BPE have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
