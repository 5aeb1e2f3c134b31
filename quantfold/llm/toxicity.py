"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

1. **Learning rows.** Labelled documents take part by hash of their id, about
   ``sample_rows`` at most (a documented bound: their ids are broadcast, texts
   are not shuffled). A quarter of them, by another hash, is kept for the
   calibration; the trees never see it.
2. **Lexicon.** Words and word beginnings of four to six letters of the toxic
   learning texts, by document frequency, are compared with the frequency in
   the other learning texts; those far more frequent in toxic texts form the
   learned lexicon with their log odds as weights. Only the trees' three
   quarters are counted. ``SEED_WORDS`` are a lexicon of their own.
3. **Features** of every whole text: densities of both lexicons, distinct
   entries and summed weights, lexicon hits within five words of a
   second-person pronoun, pronoun density, capitals (A-Z) and runs of three of them,
   punctuation, words written with digits or symbols for letters, the lexicon
   hits that appear once these are undone, letter runs, and length.
4. **Trees** (Spark ML) on the features; the share of their votes is mapped to
   a probability by isotonic regression on the calibration rows.

Edge cases: a null or empty text has zero features and is scored like any
other. Labels: null marks are ignored; a doc_id with several marks is toxic if
any says so; ids without a document do nothing. Rows that repeat a doc_id each
count and each get a score. Without learning rows, or with one class only, the
score is the share of toxic learning rows (0 without any). Where one of the
two classes is missing from the calibration rows, the trees' share is the
score. A null doc_id is never learned from. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Shared, stored

# Common insults and second-person pronouns (English, German, French, Spanish).
SEED_WORDS = frozenset("""
idiot idiots stupid moron morons loser losers trash garbage scum pathetic worthless disgusting clown dumb fool imbecile
jerk pig ugly hate shut kill dummkopf dumm trottel abschaum versager arschloch idioten widerlich connard crétin
imbécile débile nul ordure pourriture salaud estúpido idiota imbécil basura escoria asqueroso tonto payaso
""".split())
SECOND_PERSON = frozenset("""
you your yours yourself u ur du dich dir dein deine deinen deiner euch euer ihr sie tu te toi ton ta tes vous votre vos
tú ti usted ustedes vosotros tus
""".split())
#: Signs written for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")

FEATURES = ("hits_per_word", "hits", "distinct_hits", "weight_per_word", "weight_top", "seed_per_word", "near_you_per_hit",
            "near_you", "you_per_word", "capitals", "shouted", "punctuation", "exclaimed", "disguised_per_word",
            "disguised_hits", "letter_runs", "log_words")
BEGINNINGS = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"[013457@$!]")
_GAP = re.compile(r"[ \n]")
_EDGES = ".,;:!?\"'()[]"
_NEAR = 5


def entries_of(word: str) -> list[str]:
    """The word and its beginnings (marked by a dash) under which a lexicon may hold it."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)]


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def document_counts(texts: DataFrame, wanted: frozenset | None = None, flush: int = 200_000) -> DataFrame:
    """(entry, n): partial document counts of lexicon entries, all or ``wanted`` ones; sum them by entry."""
    sent = Shared(texts.sparkSession, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = sent.value
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              names=["entry", "n"])

        for batch in batches:
            for text in _texts(batch, "text"):
                found = {e for w in set(_WORD.findall(text.lower())) for e in entries_of(w)}
                counts.update(found if only is None else found & only)
                if len(counts) >= flush:
                    yield out()
                    counts.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def learn_lexicon(rows: DataFrame, *, entries: int = 2000, least_share: float = 0.002, least_docs: int = 4,
                  odds: float = 6.0) -> dict[str, float]:
    """entry -> log odds, from (text, toxic) rows.

    An entry must be in ``least_docs`` toxic texts and in ``least_share`` of
    them (which bounds how many can pass), and ``odds`` times as frequent there
    as in the other texts; the ``entries`` with the largest scores are kept.
    """
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    least = max(least_docs, math.ceil(least_share * toxic))
    seen = {r["entry"]: r["n"] for r in document_counts(rows.filter("toxic = 1")).filter(F.col("n") >= least).collect()}
    other = {r["entry"]: r["n"] for r in document_counts(rows.filter("toxic = 0"), frozenset(seen)).collect()} if seen else {}
    scored = []
    for e, n in seen.items():
        p, q = (n + 0.5) / (toxic + 1), (other.get(e, 0) + 0.5) / (clean + 1)
        if p >= odds * q:
            scored.append((math.log(p / q) * math.sqrt(n), e, math.log(p / q)))
    scored.sort(key=lambda s: (-s[0], s[1]))
    return {e: w for _, e, w in scored[:entries]}


class Scorer:
    """Dense features of a text under a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.heads = {e.rstrip("-")[:4] for e in lexicon}
        self.known = SECOND_PERSON | SEED_WORDS

    def weight(self, word: str) -> tuple[float, str]:
        """(largest weight, its entry) of a word; 0 without an entry."""
        if word[:4] not in self.heads:
            return 0.0, ""
        return max((self.lexicon.get(e, 0.0), e) for e in entries_of(word))

    def disguised(self, text: str) -> list[str]:
        """Words between white space that hold a digit or symbol between letters."""
        out, end = [], 0
        for m in _SIGN.finditer(text):
            if m.start() < end:
                continue
            # only the stretch since the last word is searched, so a long text costs its length
            start = max(end, text.rfind(" ", end, m.start()) + 1, text.rfind("\n", end, m.start()) + 1)
            after = _GAP.search(text, m.end())
            end = after.start() if after else len(text)
            word = text[start:end].strip(_EDGES)
            inner = word[1:-1]
            if word[:1].isalpha() and word[-1:].isalpha() and not inner.isalpha() and _SIGN.search(inner) and word.replace(
                    "@", "").replace("$", "").replace("!", "").isalnum():
                out.append(word)
        return out

    def features(self, text: str) -> list[float]:
        words = _WORD.findall(text.lower())
        n = max(1, len(words))
        heads, known = self.heads, self.known
        marked = [(i, w) for i, w in enumerate(words) if w in known or w[:4] in heads]
        found = [(i, *f) for i, w in marked if (f := self.weight(w))[0] > 0]
        you = [i for i, w in marked if w in SECOND_PERSON]
        seed = [i for i, w in marked if w in SEED_WORDS]
        near, k = 0, 0
        for i in sorted({f[0] for f in found}.union(seed)):
            while k < len(you) and you[k] < i - _NEAR:
                k += 1
            near += k < len(you) and you[k] <= i + _NEAR
        hits = len(found)
        disguised = self.disguised(text)
        undone = [d.lower().translate(LOOKALIKES) for d in disguised]
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        capital = (code >= 65) & (code <= 90)
        letter = capital | ((code >= 97) & (code <= 122)) | (code >= 0xC0)
        same = (code[1:] == code[:-1]) & letter[1:]
        letters = max(1, int(letter.sum()))
        return [hits / n, math.log1p(hits), math.log1p(len({f[2] for f in found})), sum(f[1] for f in found) / n,
                max((f[1] for f in found), default=0.0), len(seed) / n, near / max(1, hits), math.log1p(near), len(you) / n,
                int(capital.sum()) / letters, _runs(capital[2:] & capital[1:-1] & capital[:-2]) / n,
                sum(map(text.count, ".,;:-\"'()")) / max(1, len(text)), (text.count("!") + text.count("?")) / n,
                len(disguised) / n, float(sum(w in SEED_WORDS or self.weight(w)[0] > 0 for w in undone)),
                _runs(same[1:] & same[:-1]) / n, math.log1p(len(words))]


def _runs(on: np.ndarray) -> int:
    """Runs of true values."""
    return int(on[:1].sum() + (on[1:] & ~on[:-1]).sum())


def featurise(docs: DataFrame, lexicon: dict[str, float], *keep: str) -> DataFrame:
    """``keep`` columns and ``features`` (array of double, in the order of ``FEATURES``) of every whole text."""
    sent = Shared(docs.sparkSession, lexicon)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "features array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            values = pa.array([scorer.features(t) for t in _texts(batch, "text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*kept, values], names=[*(f.name for f in fields), "features"])

    return rows.mapInArrow(run, schema)


def learning_ids(labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, toxic, calibrate) of about ``sample_rows`` labelled ids at most, by hash of the id."""
    marks = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    n = marks.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(1, n)))
    return marks.filter(share).withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(4)) == 0)


def score(docs: DataFrame, labels: DataFrame, learn, *, sample_rows: int = 100_000, trees: int = 40, depth: int = 4) -> DataFrame:
    """doc_id, features and ``score`` of every row of ``docs`` (doc_id, text).

    ``labels`` has (doc_id, toxic); ``learn`` is a condition on ``doc_id``
    that says which documents may be learned from.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # bounded by sample_rows: a small table that goes to every task
    ids = stored(learning_ids(labels.filter(learn), sample_rows))
    texts = rows.join(F.broadcast(ids), "doc_id")
    lexicon = learn_lexicon(texts.filter("NOT calibrate").select("text", "toxic"))
    features = stored(featurise(rows, lexicon, "doc_id"))
    learned = stored(features.join(F.broadcast(ids), "doc_id"))
    counts = {(r["calibrate"], r["toxic"]): r["n"] for r in
              learned.groupBy("calibrate", "toxic").agg(F.count("*").alias("n")).collect()}  # four rows at most
    total = sum(counts.values())
    if not counts.get((False, 0)) or not counts.get((False, 1)):
        share = sum(n for (_, t), n in counts.items() if t) / total if total else 0.0
        return features.withColumn("score", F.lit(share))
    vectors = learned.select("calibrate", F.col("toxic").cast("double").alias("label"), array_to_vector("features").alias("v"))
    trained = GBTClassifier(featuresCol="v", maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=5,
                            seed=11).fit(vectors.filter("NOT calibrate").coalesce(16))
    vote = lambda t: trained.transform(t).withColumn("raw", vector_to_array("probability")[1])
    scored = vote(features.withColumn("v", array_to_vector("features")))
    if not counts.get((True, 0)) or not counts.get((True, 1)):
        return scored.select("doc_id", "features", F.col("raw").alias("score"))
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(
        vote(vectors.filter("calibrate")).select("raw", "label"))
    return isotonic.transform(scored).select("doc_id", "features", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)).alias("score"))
