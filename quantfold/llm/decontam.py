"""Benchmark decontamination with a positional inverted index, in native operations.

1. **Index.** Every training text is cut into words; the positions of words
   that occur in the benchmark are stored as a table of postings (row, position,
   term). A closing posting of each row holds its word count.
2. **Rarest terms first.** Each window (``size`` consecutive item words, or a
   shorter item whole) names its two rarest terms by the index's own counts.
   The lists of the rarest are fetched, shifted by their offset in the item, and
   intersected with the shifted list of the second: what is left says where an
   item may lie in a text (row, item, shift). Windows with a term that no text
   has are skipped.
3. **Exact phrases.** The postings of those rows are intersected with all
   shifted words of the item; runs of ``size`` consecutive words are occurrences.
4. **Proximity matches.** An item is near when ``near_share`` of its distinct
   terms occur within its length plus ``slack`` words around such a place.

Nothing is compared pairwise: all joins are equi joins on term or on
(row, position, term). The rows of step 3 are broadcast only when counted to be
fewer than ``BROADCAST_ROWS``; otherwise the join shuffles.

Edge cases: null or wordless texts and items have no words, hence no hit.
Repeated rows are separate results; equal item_ids with different texts count
as one item. Rows without doc_id or item_id work like others (a null item_id
adds no name to the list). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import lower_ascii, materialise, small, stored

#: Everything ASCII but letters (lower case) and digits separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Array of words of a lower-cased text (empty for null)."""
    low = lower_ascii(F.coalesce(text.cast("string"), F.lit("")))
    bare = F.regexp_replace(low, rf"^{SEPARATORS}|{SEPARATORS}$", "")
    return F.when(F.length(bare) > 0, F.split(bare, SEPARATORS)).otherwise(F.array().cast("array<string>"))


def item_words(bench: DataFrame) -> DataFrame:
    """(item, item_id, length, offset, word): one row per item word."""
    items = bench.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    return materialise(items.select(F.xxhash64("item_id", "w").alias("item"), "item_id", F.size("w").alias("length"),
                                    F.posexplode("w").alias("offset", "word")))


def index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (rid, pos, term) of vocabulary words; term -1 closes a row with its word count and doc_id."""
    # one list of words a row; the closing empty word is a term of its own
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id",
                       F.concat(words_of(F.col("text")), F.array(F.lit(""))).alias("w"))
    tokens = rows.select("rid", "doc_id", F.posexplode("w").alias("pos", "word"))
    return stored(tokens.join(small(vocabulary), "word")
                  .select("rid", F.when(F.col("term") == -1, F.col("doc_id")).alias("doc_id"), "pos", "term"))


def places(postings: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(rid, item, shift): where the two rarest terms of some window stand at the right distance."""
    df = postings.filter("term >= 0").groupBy("term").agg(F.count("*").alias("df"))
    words = materialise(items.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
                        .select("item", "length", "offset", "term", "df"))
    span = F.least(F.lit(size), F.col("length"))
    windows = (words.select("item", "length", "offset", "term", "df", F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("offset") - span + 1), F.least(F.col("offset"), F.col("length") - span))).alias("at"))
        .groupBy("item", "at").agg(F.array_sort(F.collect_list(F.struct("df", "offset", "term"))).alias("rare")))
    anchors = materialise(windows.filter("rare[0].df > 0").select(
        "item", F.col("rare")[0].alias("a"), F.coalesce(F.get("rare", F.lit(1)), F.col("rare")[0]).alias("b"))
        .select("item", F.col("a.offset").alias("oa"), F.col("a.term").alias("ta"),
                F.col("b.offset").alias("ob"), F.col("b.term").alias("tb")).distinct())
    first = postings.join(small(anchors), F.col("term") == F.col("ta")).select(
        "rid", "item", (F.col("pos") - F.col("oa")).alias("shift"), (F.col("pos") - F.col("oa") + F.col("ob")).alias("pos"),
        F.col("tb").alias("term"))
    seconds = materialise(anchors.select(F.col("tb").alias("term")).distinct())
    second = postings.select("rid", "pos", "term").join(small(seconds), "term", "left_semi")
    return materialise(first.join(second, ["rid", "pos", "term"]).select("rid", "item", "shift").distinct())


def phrases(near: DataFrame, found: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(rid, item_id, start, length): maximal runs of matching words that hold a window."""
    wanted = found.join(items, "item").select(
        "rid", "item", "item_id", "shift", F.col("length").alias("whole"), "offset", (F.col("shift") + F.col("offset")).alias("pos"), "term")
    same = wanted.join(near.select("rid", "pos", "term"), ["rid", "pos", "term"])
    order = F.row_number().over(Window.partitionBy("rid", "item", "shift").orderBy("offset"))
    runs = (same.withColumn("run", F.col("offset") - order)
            .groupBy("rid", "item", "item_id", "shift", "whole", "run").agg(F.min("pos").alias("start"), F.count("*").alias("length")))
    return runs.filter(F.col("length") >= F.least(F.lit(size), F.col("whole"))).select("rid", "item_id", "start", "length")


def near_items(near: DataFrame, found: DataFrame, items: DataFrame, slack: int, share: float) -> DataFrame:
    """(rid, item_id): items most of whose terms stand around a place."""
    terms = items.groupBy("item", "item_id", "length", "term").agg(F.min("offset").alias("offset"))
    kinds = terms.groupBy("item").agg(F.count("*").alias("kinds"))
    wanted = found.join(terms, "item").select("rid", "item", "item_id", "shift", "length", "term")
    got = (wanted.join(near.select("rid", "pos", "term"), ["rid", "term"])
           .filter((F.col("pos") >= F.col("shift") - slack) & (F.col("pos") < F.col("shift") + F.col("length") + slack))
           .groupBy("rid", "item", "item_id", "shift", "term").agg(F.lit(1).alias("one"))
           .groupBy("rid", "item", "item_id", "shift").agg(F.count("*").alias("terms")))
    return got.join(kinds, "item").filter(F.col("terms") >= share * F.col("kinds")).select("rid", "item_id").distinct()


def scan(docs: DataFrame, bench: DataFrame, *, size: int = 10, slack: int = 5, near_share: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as text), near_items, contaminated; one row per row of ``docs``."""
    raw = item_words(bench)
    vocabulary = materialise(raw.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
                             .unionByName(docs.sparkSession.createDataFrame([("", -1)], "word string, term long")))
    items = materialise(raw.join(small(vocabulary), "word").drop("word"))
    postings = index(docs, vocabulary)
    found = places(postings, items, size)
    rids = materialise(found.select("rid").distinct())
    near = materialise(postings.filter("term >= 0").select("rid", "pos", "term").join(small(rids), "rid", "left_semi"))
    runs = materialise(phrases(near, found, items, size))
    hit = (runs.select("rid", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
           .groupBy("rid").agg(F.count("*").alias("n_hit")))
    names = runs.groupBy("rid").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    around = (near_items(near, found, items, slack, near_share).groupBy("rid")
              .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("near_items")))
    none = F.array().cast("array<string>")
    return (postings.filter("term = -1").select("rid", "doc_id", F.col("pos").cast("long").alias("n_words"))
            .join(hit, "rid", "left").join(names, "rid", "left").join(around, "rid", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def remove(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` without a benchmark phrase; rows are told apart by doc_id and text."""
    found = scan(docs.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("doc_id"), "text"), bench, **options)
    bad = found.filter("contaminated").select(F.col("doc_id.doc_id").alias("__d"), F.col("doc_id.t").alias("__t")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__d"]) & (F.xxhash64(docs["text"]) == bad["__t"]), "left_anti")
