"""Language ID: nearest centroid over normalised TF-IDF character n-grams.

Fitting
  1. Document frequencies of hashed n-grams over *all* learning rows (partial
     counts per task, summed by bucket; ``dims`` rows come back).
  2. A bounded sample of ``sample_per_lang`` learning rows a language (chosen
     by hash of the id) is vectorised and clustered per language by spherical
     k-means into up to ``clusters`` centroids, one Spark group a language.
     Seeds are drawn by k-means++; a cluster that ends a round with fewer than
     ``LEAST`` rows is drawn anew, and left out if that is so to the end.
  3. A rejection distance per language and length class (binary logarithm of
     the text's distinct n-grams): the ``quantile`` of the distances of sample
     rows from their nearest own centroid, so a few odd or mislabelled rows do
     not move it, and ``slack`` of the way from there to 1, never above
     ``max_distance``. The rows' beginnings of 4, 8, 16, ... characters count
     too: short texts lie farther out, whatever lengths the sample has.

Predicting is one narrow pass: every whole text becomes a vector, the cosine
with each centroid is a matrix product, the nearest centroid names the
language. A text without a letter is ``und``; a text farther from the winner
than its rejection distance is marked ``rejected`` (and keeps the nearest
language as ``lang_pred``).

Edge cases: a null or empty text, or one without any letter, is ``und`` with
score 0 and rejected. Rows without language are never learned from. With no
learning row at all every text is ``und``. Ties go to the first language in
alphabetical order. Extra columns of the input are kept; the columns
``lang_pred``, ``score`` and ``rejected`` are replaced. Repeated rows get the
same answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Shared, mix

UNKNOWN = "und"
#: Rows of the sample that a cluster needs, and texts that a length class needs.
LEAST = 5
#: Length classes; the last one has no upper end.
CLASSES = 14
_U = np.uint64


def ngram_buckets(text: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the hashed 1- to 3-grams of the lower-cased letters.

    Runs of characters that are not letters become one space, so digits and
    punctuation carry no weight.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(_letters(code), code, 32).astype(np.uint64)
    code = np.concatenate([[_U(32)], code, [_U(32)]])
    code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
    one = code[code != 32]
    two = code[:-1] * _U(0x110000) + code[1:] + _U(1 << 42)
    three = (two[:-1] * _U(0x110000) + code[2:]) ^ _U(1 << 63)
    ids = (mix(np.concatenate([one, two, three])) & _U(dims - 1)).astype(np.int64)
    counts = np.bincount(ids, minlength=dims)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _letters(code: np.ndarray) -> np.ndarray:
    """Which code points are letters: A-Z, a-z, and above ASCII all but known marks."""
    ascii_letter = ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128)
    high = code >= 0xAA
    mark = ((code >= 0x2000) & (code <= 0x2BFF)) | ((code >= 0x3000) & (code <= 0x3004)) | (code >= 0x1F000) \
        | ((code >= 0xAB) & (code <= 0xBF) & (code != 0xB5) & (code != 0xBA)) | (code == 0xD7) | (code == 0xF7)
    return ascii_letter | (high & ~mark)


def length_class(distinct: int) -> int:
    """Class of a text with so many distinct n-grams."""
    return min(max(distinct, 1).bit_length(), CLASSES) - 1


@dataclass
class LanguageModel:
    """Centroids (one row each), their languages, idf and rejection distances.

    Its size is fixed by ``dims``, ``clusters`` and the number of languages.
    """

    dims: int
    langs: list[str] = field(default_factory=list)       # of each centroid
    centroids: np.ndarray | None = None                   # (k, dims) unit rows
    idf: np.ndarray | None = None
    reach: np.ndarray | None = None                       # rejection distance by centroid (its language's) and length class

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, counts = ngram_buckets(text, self.dims)
        value = (1.0 + np.log(counts)) * self.idf[at]
        norm = float(np.sqrt((value * value).sum()))
        return at, value / norm if norm else value

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        at, value = self.vector(text)
        cos = self.centroids[:, at] @ value
        k = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[k])))
        return self.langs[k], score, bool(1.0 - score > self.reach[k, length_class(len(at))])


def _counting(dims: int):
    """Function over Arrow batches of texts: how many hold each n-gram bucket, and under ``dims`` how many there are."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, np.int64), 0
        # few texts at a time: the tasks of an executor share its memory with the JVM
        for part in (batch.slice(lo, 256) for batch in batches for lo in range(0, batch.num_rows, 256)):
            for text in part.column(0).to_pylist():
                at, _ = ngram_buckets(text, dims)
                df[at] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, dims).astype(np.int32)), pa.array(np.append(df[at], n))], names=["bucket", "df"])
    return count


def _document_frequencies(rows: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    got = (rows.select("text").mapInArrow(_counting(dims), "bucket int, df long")
           .groupBy("bucket").agg(F.sum("df").alias("df")).toPandas())  # at most dims + 1 rows
    out = np.zeros(dims + 1, np.int64)
    out[got["bucket"].to_numpy()] = got["df"].to_numpy()
    return out[:dims], int(out[dims])


def _reach(model: LanguageModel, c: np.ndarray, texts: list[str], quantile: float) -> np.ndarray:
    """Quantile of the distances from the nearest of ``c`` by length class."""
    found: list[list[float]] = [[] for _ in range(CLASSES)]
    for text in texts:
        for end in (*(2 << i for i in range(1, (len(text) - 1).bit_length() - 1)), len(text)):
            if any(map(str.isalpha, text[:end])):
                at, value = model.vector(text[:end])
                found[length_class(len(at))].append(float(1.0 - (c[:, at] @ value).max()))
    have = [i for i in range(CLASSES) if len(found[i]) >= min(LEAST, len(texts))] or [i for i in range(CLASSES) if found[i]]
    # a class without texts takes the nearest one that has some
    return np.array([np.quantile(found[min(have, key=lambda j: abs(i - j))], quantile) for i in range(CLASSES)])


def _cluster(model: LanguageModel, clusters: int, rounds: int, slack: float, quantile: float, max_distance: float):
    """Group function: spherical k-means over one language's bounded sample."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values(["__h", "text"])["text"].tolist()
        x = np.zeros((len(texts), model.dims), np.float32)
        for i, text in enumerate(texts):
            at, value = model.vector(text)
            x[i, at] = value
        k, least = max(1, min(clusters, len(texts) // 20)), min(LEAST, len(texts))
        rng = np.random.default_rng(7)

        def draw(c: np.ndarray) -> np.ndarray:
            """A row, more likely the farther it is from the nearest centre."""
            far = np.maximum(1.0 - (x @ c.T).max(1), 0.0).astype(float) if len(c) else np.ones(len(x))
            return x[rng.choice(len(x), p=far / far.sum() if far.sum() > 0 else None)]

        def unit(c: np.ndarray) -> np.ndarray:
            return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)

        c = np.zeros((0, model.dims), np.float32)
        while len(c) < k:
            c = np.vstack([c, draw(c)])
        for i in range(rounds):
            own = (x @ c.T).argmax(1)
            large = np.bincount(own, minlength=k) >= least
            c = unit(np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)]))
            for j in np.flatnonzero(~large) if i < rounds // 2 else ():
                c[j] = draw(c[large] if large.any() else c)
        # stray (mislabelled) rows name no centroid
        large = np.bincount((x @ c.T).argmax(1), minlength=k) >= least
        c = c[large] if large.any() else c
        typical = _reach(model, c, texts, quantile)
        reach = np.minimum(max_distance, typical + slack * (1.0 - typical))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "reach": [reach.tolist()] * len(c),
                             "centroid": [row.astype(np.float32).tobytes() for row in c]})
    return run


def fit(rows: DataFrame, *, lang: str = "lang", text: str = "text", dims: int = 1 << 13, clusters: int = 4,
        sample_per_lang: int = 1000, rounds: int = 8, slack: float = 0.25, quantile: float = 0.95,
        max_distance: float = 0.97) -> LanguageModel:
    """Learn from every row of ``rows`` whose ``lang`` and ``text`` are set.

    ``sample_per_lang`` bounds the rows that are clustered (the idf counts
    read all rows). ``dims`` must be a power of two.
    """
    learn = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    df, n = _document_frequencies(learn, dims)
    model = LanguageModel(dims)
    if not n:
        return model
    model.idf = (np.log((1.0 + n) / (1.0 + df)) + 1.0).astype(np.float32)
    totals = learn.groupBy("lang").count()
    # rows below a hash limit: about sample_per_lang, then exactly that many at most by a top-k per language
    share = F.least(F.lit(1.0), F.lit(1.3 * sample_per_lang + 50) / F.col("count"))
    drawn = (learn.withColumn("__h", F.xxhash64("text", F.lit(7)))
             .join(F.broadcast(totals), "lang")  # one row a language
             .filter((F.col("__h").cast("double") / F.lit(2.0**63) + 1) / 2 <= share)
             .groupBy("lang", "__h").agg(F.first("text").alias("text")))
    got = drawn.groupBy("lang").applyInPandas(
        lambda pdf: _cluster(model, clusters, rounds, slack, quantile, max_distance)(pdf.nsmallest(sample_per_lang, "__h")),
        "lang string, reach array<double>, centroid binary").toPandas().sort_values("lang", kind="stable")
    model.langs = got["lang"].tolist()
    model.reach = np.stack(got["reach"].to_list())
    model.centroids = np.stack([np.frombuffer(b, np.float32) for b in got["centroid"]])
    return model


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``."""
    shared = Shared(docs.sparkSession, model)  # dims x centroids floats

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                                T.StructField("rejected", T.BooleanType())]))
    def named(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.nearest(t) for t in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score", "rejected"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected", "__lang")]
    return (docs.withColumn("__lang", named(F.col(text).cast("string")))
            .select(*[F.col(f"`{c}`") for c in kept], "__lang.lang_pred", "__lang.score", "__lang.rejected"))


def held_out(key: Column) -> Column:
    """crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))
