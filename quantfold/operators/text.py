"""Text table operators: sentences, token statistics, TF-IDF similarity, selection.

Scale notes
* Sentence splitting, paragraphs and keyword windows are array functions on
  one row (a page), so they never shuffle.
* Token counts and vocabulary statistics are hash aggregates with map-side
  partial aggregation: a very frequent token ("the") collapses per task
  before any exchange.
* Similarity to a corpus never forms document × corpus pairs: the mean of
  cosines equals the dot product with the mean of unit corpus vectors, so
  each document token meets one centroid row per term (an equi join on
  term, broadcast when the vocabulary is counted to be small, and split by
  AQE as a skewed join when it is not).
* De-duplication keeps the first copy with ``min_by`` in a hash aggregate,
  so a text repeated a million times is still one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.nulls import safe_div
from ..session import cut_lineage
from .ranking import top_rows


# ---- sentences / paragraphs (h08, h10, f11, c07) ----------------------------------
def explode_sentences(df: DataFrame, text_col: str, out: str = "sentence", pos: str = "sent_no",
                      skip_if_contains: str | None = None) -> DataFrame:
    """h08/c07: one row per '. '-separated piece, keeping its position.

    ``skip_if_contains`` drops whole texts containing a phrase inside the
    generator (no separate filter on the derived text, which the optimizer
    would push below the projection and so evaluate the text twice).
    """
    arr = T.split_sentences(text_col)
    if skip_if_contains is not None:
        arr = F.when(F.col(text_col).contains(skip_if_contains), F.lit(None)).otherwise(arr)
    return _exploded(df, arr, pos, out)


def _exploded(df: DataFrame, arr: Column, pos: str, out: str) -> DataFrame:
    """``posexplode`` by its outer form: for the inner one the optimizer adds a filter on the array, so every text is cleaned and cut twice."""
    return df.select("*", F.posexplode_outer(arr).alias(pos, out)).where(F.col(pos).isNotNull())


def sentences_with_paragraphs(df: DataFrame, text_col: str, size: int = 3) -> DataFrame:
    """h10: sentence rows with the paragraph (block of ``size`` sentences) they belong to.

    A sentence takes its own block out of the array: work in proportion to
    ``size``, however many sentences a text has.
    """
    s = _exploded(df.select("*", T.split_sentences(text_col).alias("__arr")), F.col("__arr"), "sent_no", "sentence")
    first = F.col("sent_no") - F.col("sent_no") % size
    para = F.concat_ws(" ", *[F.get("__arr", first + i) for i in range(size)])  # no sentence beyond the end: left out
    return s.withColumn("paragraph", para).drop("__arr")


def ordered_concat(df: DataFrame, keys: Sequence[str], col: str, order: Sequence[str], sep: str,
                   out: str = "text") -> DataFrame:
    """e04: per group, values joined with ``sep`` in ``order`` (bounded groups only)."""
    order_sql = ", ".join(f"`{o}`" for o in order)
    agg = F.expr(f"listagg(`{col}`, '{sep}') WITHIN GROUP (ORDER BY {order_sql})")
    return df.groupBy(*keys).agg(agg.alias(out))


# ---- tokens (e03, g01, d11, h04) ---------------------------------------------------
def token_rows(df: DataFrame, id_cols: Sequence[str], text_col: str, lower: bool = True,
               split_ws: bool = False) -> DataFrame:
    """One row per token occurrence: regex tokens, or whitespace pieces when ``split_ws``."""
    if split_ws:
        src = F.lower(F.col(text_col)) if lower else F.col(text_col)
        toks = F.filter(F.split(src, f"{T.WS}+"), lambda t: F.length(t) > 0)
    else:
        toks = T.tokens(text_col)
    return df.select(*id_cols, F.explode(toks).alias("token"))


def token_frequency(df: DataFrame, text_col: str, split_ws: bool = True) -> DataFrame:
    """e03: frequency of every (lower-cased) token."""
    return token_rows(df, [], text_col, True, split_ws).groupBy("token").agg(F.count(F.lit(1)).alias("frequency"))


def top_tokens(freq: DataFrame, k: int = 200) -> DataFrame:
    """g01: k most frequent tokens (ties by token) — a bounded TakeOrderedAndProject."""
    return freq.orderBy(F.col("frequency").desc(), F.col("token")).limit(k)


def lexicon_words(lex: DataFrame, k: int = 200) -> list[str]:
    """The lexicon as a Python list: it is a top-k result, so at most ``k`` words."""
    return [r[0] for r in lex.limit(k).collect()]


def lexicon(minutes_clean: DataFrame, text_col: str = "content", k: int = 200,
            remove: Sequence[str] = T.REMOVE_WORDS) -> DataFrame:
    """Policy lexicon: top-k tokens of the cleaned minutes minus the removal list (g01 + c09)."""
    top = top_tokens(token_frequency(minutes_clean, text_col), k)
    return top.where(~F.col("token").isin(list(remove))).select(F.col("token").alias("word"))


# ---- TF-IDF and similarity (h12, h13, d08) -----------------------------------------
def tfidf_model(corpus: DataFrame, id_col: str, text_col: str, n: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """h12 fit: (idf per term, unit TF-IDF weights of the corpus).

    idf = ln((1 + n) / (1 + df)) + 1 (smoothed); weights are L2-normalised
    per corpus document. The corpus document count is a scalar subquery.
    """
    counts = token_rows(corpus, [id_col], text_col).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"))
    n = corpus.select(F.count(F.lit(1))).scalar() if n is None else n
    idf = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df")) \
        .select("token", (F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + F.lit(1.0)).alias("idf"))
    w = counts.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    unit = w.select(id_col, "token", (F.col("w") / norm).alias("w"))
    return idf, unit


def save_tfidf(corpus: DataFrame, id_col: str, text_col: str, path: str) -> str:
    """h12 fit as a stored model: ``terms`` (token, df, idf) and one row of ``settings`` under ``path``.

    Another job loads it with ``load_tfidf`` and applies it to another corpus.
    """
    n = corpus.count()
    counts = token_rows(corpus, [id_col], text_col).select(id_col, "token").distinct()
    terms = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    terms = terms.select("token", "df", (F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + F.lit(1.0)).alias("idf"))
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    corpus.sparkSession.createDataFrame([(n, T.TOKEN)], "documents long, token_pattern string").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/settings")
    return path


def load_tfidf(spark, path: str) -> DataFrame:
    """(token, df, idf) of a stored model; its texts must have been cut into the same kind of tokens as ours."""
    settings = spark.read.parquet(f"{path}/settings").first()
    if settings is None or settings["token_pattern"] != T.TOKEN:
        raise ValueError(f"the model at {path} was fitted with other tokens")
    return spark.read.schema("token string, df bigint, idf double").parquet(f"{path}/terms")


def tfidf_transform(df: DataFrame, id_cols: Sequence[str], text_col: str, idf: DataFrame) -> DataFrame:
    """h12 apply: unit TF-IDF weights of each text over the fitted vocabulary only.

    Unseen terms have no weight; a text without a known term has no row.
    """
    counts = token_rows(df, id_cols, text_col).groupBy(*id_cols, "token").agg(F.count(F.lit(1)).alias("tf"))
    w = counts.join(idf.select("token", "idf"), "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*id_cols)))
    return w.select(*id_cols, "token", (F.col("w") / norm).alias("w"))


def corpus_centroid(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Mean of the unit corpus vectors per term, with the term's idf: (token, idf, c)."""
    m = corpus.select(F.count(F.lit(1))).scalar()  # one count: idf's n and the mean's m
    idf, unit = tfidf_model(corpus, id_col, text_col, m)
    cen = unit.groupBy("token").agg((F.sum("w") / m).alias("c"))
    return idf.join(cen, "token")


#: Terms of a corpus (a word and two numbers each) that may be broadcast.
BROADCAST_TERMS = 200_000


def similarity_to_corpus(df: DataFrame, id_cols: Sequence[str], text_col: str, centroid: DataFrame,
                         out: str = "score") -> DataFrame:
    """h13/d08: mean cosine similarity of every text to the corpus documents.

    mean_j cos(d, c_j) = (d / |d|) · mean_j (c_j / |c_j|). The texts are
    dealt by their ids once; then tokens are exploded (outer, so a text
    without tokens keeps a row), counted per (text, token), left-joined to the
    centroid and summed per text where they are: no token row travels. The
    centroid is computed first and broadcast if it has at most
    ``BROADCAST_TERMS`` terms; a larger one takes a shuffled join.
    A text without a known term scores 0; a NULL or empty text gets a
    NULL score. The emptiness flag is computed beside the tokens rather than
    filtered on, because a filter on a derived text column is pushed below
    its projection and would evaluate the whole cleaning expression twice.
    """
    ids = list(id_cols)
    t = F.col(text_col)
    centroid = cut_lineage(centroid)
    if centroid.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        centroid = F.broadcast(centroid)
    dealt = df.select(*ids, t.alias("__t")).repartition(*[F.col(i) for i in ids])
    t = F.col("__t")
    toks = dealt.select(*ids, (t.isNull() | (F.length(t) == 0)).alias("__e"), F.explode_outer(T.tokens("__t")).alias("token"))
    counts = toks.groupBy(*ids, "__e", "token").agg(F.count("token").alias("tf"))
    j = counts.join(centroid, "token", "left")
    per = j.groupBy(*ids, "__e").agg(
        F.sum(F.col("tf") * F.col("idf") * F.col("c")).alias("__dot"),
        F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("__norm"))
    score = F.when(F.col("__e"), F.lit(None).cast("double")).otherwise(
        F.coalesce(safe_div(F.col("__dot"), F.col("__norm")), F.lit(0.0)))
    return per.select(*ids, score.alias(out))


# ---- selection (g02, g06, b12, h06) ---------------------------------------------------------
def first_by(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """g06: one row per distinct ``key``, the first in ``order`` (hash aggregate, skew-safe)."""
    payload = F.struct(*[F.col(c) for c in cols])
    ordk = F.struct(*[F.col(o) for o in order])
    return (df.groupBy(key).agg(F.min_by(payload, ordk).alias("__p"))
              .select(key, *[F.col(f"__p.{c}").alias(c) for c in cols if c != key]))


def top_fraction(df: DataFrame, score: str, ties: Sequence[Column], fraction: float) -> DataFrame:
    """g02: the floor(n · fraction) rows with the highest score, ties in the order of ``ties`` (exact, nothing sorted)."""
    return top_rows(df, score, ties, fraction=fraction)
