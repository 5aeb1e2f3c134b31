"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-gram hashes (64 bits). Two
documents link when ``100 * |A & B| >= percent * |A | B|``. Steps:

1. **Global order.** A counting sketch of fixed size over all n-grams
   (summed per task, then over tasks) estimates how common each n-gram is;
   the order is (estimate, hash). Any total order is right; this one puts
   passages shared by many documents last.
2. **Fragments.** The order is cut at equal shares of all occurrences into
   ``fragments`` pieces (a lookup from sketch cell to piece).
3. **Equal sets collapse** to their smallest doc_id, so copies never pair.
4. **Candidates** share l n-grams among the rarest ``n - ceil(p n) + l`` of
   both sets, ``l = min(16, ceil(p n))``; a set that shares less than l of its
   own rarest with any other set links with none (two linked sets share l of
   them). They meet in the bucket of one n-gram among the rarest
   ``n - ceil(p n) + 1`` of both (the same bound for l = 1), so that common
   n-grams seldom open a bucket. Rare n-grams that no other set holds bound
   what a set can share at all, and differing bits of two parity maps bound
   how many n-grams differ; pairs beyond either bound are not emitted. A bucket of m sets does not emit
   its m^2 pairs: its members meet some pivots a round, four times as many in the next; members that ended up in
   one component need no further meeting. Once the members outside a
   bucket's largest component are few, they meet the rest directly. Every
   candidate pair is thus either verified or already connected.
5. **Partial overlaps** of a candidate pair are counted in every fragment
   separately (sorted pieces joined on set and fragment) and summed per pair;
   the sum decides exactly.

The hashes decide equality of n-grams; a 64-bit collision inside one pair's
sets would be needed to change an overlap.

Edge cases: null or wordless text is the empty set and links with nothing
(not with another empty one). Fewer words than the n-gram size: the whole
sequence is one n-gram. Repeated rows with one doc_id count once. A doc_id
with several different texts takes part in links with the one of fewest
n-grams; its other rows get only their copies' class. A null doc_id is
never a link's end, its row gets the component of its text's class (null if
no other document has the text). Extra columns are ignored by ``link`` and
kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, Shared, Words, components, materialise, shingle_hashes, slices, small

#: Cells of the counting sketch that orders n-grams (its size never depends on the data).
SKETCH_CELLS = 1 << 18
_BLOCKS = 64
_U = np.uint64


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of every row of a batch."""
    for lo, hi, data, offsets in slices(batch):
        words = Words.of(data, offsets)
        for i in range(hi - lo):
            yield lo + i, np.unique(shingle_hashes(words.hashes[words.bounds[i]:words.bounds[i + 1]], size))


def parity_map(grams: np.ndarray) -> np.ndarray:
    """256 bits (four longs): whether an odd number of n-grams falls on each; two sets differ in at least the differing bits."""
    odd = np.bincount(((grams >> _U(32)) & _U(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def count_sketch(texts: DataFrame, size: int) -> np.ndarray:
    """Occurrences (one a document) of n-grams by cell of their hash."""
    width = SKETCH_CELLS // _BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH_CELLS, np.int64)
        for batch in batches:
            for _, grams in _sets(batch, size):
                cells += np.bincount((grams & _U(SKETCH_CELLS - 1)).astype(np.int64), minlength=SKETCH_CELLS) \
                    if len(grams) > SKETCH_CELLS else 0
                if len(grams) <= SKETCH_CELLS:
                    np.add.at(cells, (grams & _U(SKETCH_CELLS - 1)).astype(np.int64), 1)
        blocks = [cells[b * width:(b + 1) * width].astype(np.uint32) for b in range(_BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()),
                                          pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "cells"])

    def add(kind):
        def run(key, pdf):
            import pandas as pd
            total = np.zeros(width, np.int64)
            for b in pdf["cells"]:
                total += np.frombuffer(b, kind)
            return pd.DataFrame({"block": [key[0]], "cells": [total.tobytes()]})
        return run

    # two levels, so that no group holds one row of every task of a large job
    level1 = (texts.select("text").mapInArrow(count, "block int, cells binary")
              .withColumn("part", F.spark_partition_id() % 256)
              .groupBy("block", "part").applyInPandas(add(np.uint32), "block int, cells binary"))
    rows = level1.groupBy("block").applyInPandas(add(np.int64), "block int, cells binary").collect()
    out = np.zeros(SKETCH_CELLS, np.int64)
    for r in rows:  # _BLOCKS rows
        out[r["block"] * width:(r["block"] + 1) * width] = np.frombuffer(r["cells"], np.int64)
    return out


def fragment_of_cells(cells: np.ndarray, fragments: int) -> np.ndarray:
    """Fragment number of each sketch cell: equal shares of the order by (count, cell)."""
    order = np.lexsort((np.arange(len(cells)), cells))
    before = np.cumsum(cells[order]) - cells[order]
    out = np.empty(len(cells), np.int8)
    out[order] = np.minimum(before * fragments // max(1, int(cells.sum())), fragments - 1)
    return out


#: Rare n-grams that two linked sets must share (fewer where the sets are smaller).
SHARED = 16
#: Members of a bucket (about) that the others meet in the round after the first.
PIVOTS = 16
#: Buckets are finished directly at so many meetings a row.
FINISH = 8


def _prefix_length(n: int, percent: int) -> int:
    least = -(-percent * n // 100)
    return n - least + min(SHARED, least)


#: Whether a bucket's member can link with any other one, by the bucket's ``_far_reaching`` figures.
_MEETS = "reach >= n OR (smallest <= reach AND n <= widest)"


def _far_reaching(rows: DataFrame) -> list[Column]:
    """Least size and largest reach of the sets that reach beyond their own size (of two linked sets the smaller one does)."""
    far = rows["reach"] >= rows["n"]
    return [F.min(F.when(far, rows["n"])).alias("smallest"), F.max(F.when(far, rows["reach"])).alias("widest")]


def link(docs: DataFrame, *, size: int = 4, percent: int = 85, fragments: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cells = count_sketch(docs, size)
    shared = Shared(spark, (np.minimum(cells, np.iinfo(np.int32).max).astype(np.int32), fragment_of_cells(cells, fragments)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value[0]
        for batch in batches:
            n, print_, rare, maps = [], [], [], []
            for _, grams in _sets(batch, size):
                n.append(len(grams))
                maps.append(parity_map(grams))
                print_.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                first = np.lexsort((grams, count[(grams & _U(SKETCH_CELLS - 1)).astype(np.int64)]))
                rare.append(grams[first[:_prefix_length(len(grams), percent)]].view(np.int64))
            ends = np.cumsum([0, *map(len, rare)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(print_, pa.binary()), pa.array(maps, pa.list_(pa.int64())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rare) if rare else [], pa.int64()))],
                names=["doc_id", "n", "fp", "map", "rare"])

    described = materialise(docs.mapInArrow(describe, "doc_id long, n long, fp binary, map array<long>, rare array<long>"))
    classes = materialise(described.groupBy("n", "fp", "map").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")))
    # an id with several texts: only the one with fewest n-grams is a node
    twice = (classes.filter("n > 0").groupBy("rep").agg(F.count("*").alias("k"), F.min(F.struct("n", "fp")).alias("s"))
             .filter("k > 1").select(F.col("rep").alias("node"), "s.fp"))
    not_nodes = materialise(classes.filter("n > 0").join(
        twice, (F.col("rep") == F.col("node")) & (classes["fp"] != twice["fp"]), "left_semi").select("n", "fp"))
    reps = (classes.filter("n > 0 AND rep IS NOT NULL").join(small(not_nodes), ["n", "fp"], "left_anti")
            .select(F.col("rep").alias("node"), "n", "fp", "map"))
    # copies leave before their n-grams are listed: only classes of several rows need a look
    several = materialise(classes.filter("rows > 1").select("n", "fp", "rep"))
    entries = (described.filter("n > 0 AND doc_id IS NOT NULL").join(small(several), ["n", "fp"], "left")
               .filter("rep IS NULL OR doc_id = rep").join(small(not_nodes), ["n", "fp"], "left_anti")
               .select(F.col("doc_id").alias("node"), "n", F.posexplode("rare").alias("place", "h"))
               .select("node", "h", F.expr(f"place <= n - ({percent} * n + 99) DIV 100").alias("key")))
    shared_by = lambda t: t.groupBy("h").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last")
    some = materialise(entries.join(shared_by(entries).select("h"), "h").distinct())
    # "most": n-grams that a set can share with any other one, as some of its rare ones are nobody else's;
    # "reach": the largest set that it can link with, for that reason
    enough = (some.groupBy("node").agg(F.count("*").alias("k")).join(reps.select("node", "n", "map"), "node")
              .withColumn("least", F.expr(f"({percent} * n + 99) DIV 100"))
              .filter(f"k >= least({SHARED}, least)")
              .withColumn("most", F.expr(f"least - least({SHARED}, least) + k"))
              .select("node", "n", "map", F.expr(f"{100 + percent} * most DIV {percent} - n").alias("reach")))
    sizes = materialise(enough)
    shared_rare = some.join(small(sizes.drop("map")), "node")
    keys = shared_rare.filter("key").drop("key")
    buckets = (keys.groupBy("h").agg(F.count("*").alias("m"), F.min(F.when(F.col("reach") >= F.col("n"), F.col("node"))).alias("pivot"),
                                     *_far_reaching(keys)).filter("m > 1 AND pivot IS NOT NULL"))
    pruned = materialise(keys.join(buckets, "h").filter(_MEETS).select("h", "node", "pivot"))
    traits = small(sizes, BROADCAST_ROWS // 4)
    members = pruned.join(traits, "node")
    # shared rare n-grams of every set that has a bucket, at most its own length
    lists = materialise(shared_rare.join(small(pruned.select("node").distinct()), "node", "left_semi")
                        .groupBy("node", "n").agg(F.collect_list("h").alias("hs")))
    differ = " + ".join(f"bit_count(pa[{i}] ^ pb[{i}])" for i in range(4))
    possible = (f"na <= rb AND nb <= ra AND "
                f"{differ} <= na + nb - 2 * (({percent} * (na + nb) + {99 + percent}) DIV {100 + percent})")
    side = lambda x: [F.col("n").alias(f"n{x}"), F.col("reach").alias(f"r{x}"), F.col("map").alias(f"p{x}")]
    end = lambda x: traits.select(F.col("node").alias(x), *side(x))
    verified = lambda pairs: overlaps(pairs, lambda nodes: _pieces(docs, nodes, reps, shared, size), percent)

    first = materialise(pruned.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    pairs = _fitting(first.join(end("a"), "a").join(end("b"), "b").filter(possible).select("a", "b"), lists, percent)
    links = materialise(verified(pairs))
    unmet = members.filter("node <> pivot").drop("pivot")  # a pivot met its whole bucket
    pivots = PIVOTS
    while True:
        labels = components(links)
        left = materialise(unmet.join(small(labels), "node", "left")
                           .select("h", "node", "n", "reach", "map", F.coalesce("component", "node").alias("c")))
        counts = left.groupBy("h", "c").agg(F.count("*").alias("k"), *_far_reaching(left))
        # the largest component of a bucket, ties by smallest label
        mixed = (counts.groupBy("h").agg(F.sum("k").alias("m"), F.max("k").alias("top"), F.count("*").alias("parts"),
                                         F.min("smallest").alias("smallest"), F.max("widest").alias("widest"))
                 .filter("parts > 1 AND smallest IS NOT NULL"))
        largest = (counts.select("h", "c", "k").join(mixed, "h").filter("k = top")
                   .groupBy("h", "m", "smallest", "widest").agg(F.min("c").alias("main")))
        open_ = materialise(left.join(largest, "h").filter(_MEETS).drop("smallest", "widest"))
        todo = open_.agg(F.sum(F.when(F.col("c") != F.col("main"), F.col("m"))).alias("meetings"),
                         F.count("*").alias("rows")).first()  # one row
        if not todo["meetings"]:
            break
        finish = todo["meetings"] <= FINISH * todo["rows"]
        light = open_.filter("c <> main")
        if not finish:
            chosen = light.groupBy("h").agg(F.min("node").alias("first"), F.count("*").alias("k"))
            # buckets that closed stay closed: the next round looks at this one's members that did not meet all others
            now = F.expr(f"c <> main AND (node = first OR pmod(xxhash64(node), k) < {pivots})")
            marked = materialise(open_.join(chosen, "h").withColumn("now", now).drop("first", "k"))
            light, unmet = marked.filter("now"), marked.filter("NOT now").select("h", "node", "n", "reach", "map")
            pivots *= 4
        # of two sets that can link, the smaller one reaches beyond itself: the others need not meet among themselves
        far = F.col("reach") >= F.col("n")
        light = light.select("h", F.col("node").alias("a"), F.col("c").alias("ca"), *side("a"),
                             F.explode(F.when(far, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("far"))
        other = open_.select(F.col("h").alias("hb"), F.col("node").alias("b"), F.col("c").alias("cb"), *side("b"), far.alias("farb"))
        met = light.join(other, (F.col("h") == F.col("hb")) & (F.col("far") == F.col("farb")) & (F.col("ca") != F.col("cb")) & F.expr(possible))
        pairs = _fitting(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), lists, percent)
        # the components so far stand for the links they came from
        links = materialise(verified(pairs).unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
                                                        .filter("a <> b")))
        if finish:
            labels = components(links)
            break
    found = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n", "fp", F.coalesce("component", "rep").alias("component_id"))
    return (described.select("doc_id", "n", "fp").join(found, ["n", "fp"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def _pieces(docs, nodes, reps, shared, size: int) -> DataFrame:
    """(node, is_a, only_a, frag, grams): the sets of ``nodes`` (node, is_a, only_a), cut into fragments."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragment = shared.value[1]
        for batch in batches:
            row_of, frag, grams_of = [], [], []
            prints = batch.column(2).to_pylist()
            for row, grams in _sets(batch, size):
                if hashlib.blake2b(grams.tobytes(), digest_size=16).digest() != prints[row]:
                    continue
                own = fragment[(grams & _U(SKETCH_CELLS - 1)).astype(np.int64)]
                for f in np.unique(own):
                    row_of.append(row)
                    frag.append(int(f))
                    grams_of.append(grams[own == f].view(np.int64))
            ends = np.cumsum([0, *map(len, grams_of)])
            rows = pa.array(row_of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(3).take(rows), batch.column(4).take(rows), pa.array(frag, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                          pa.array(np.concatenate(grams_of) if grams_of else [], pa.int64()))],
                names=["node", "is_a", "only_a", "frag", "grams"])

    wanted = materialise(nodes.join(reps.select("node", "fp"), "node")
                         .select(F.col("node").alias("doc_id"), "fp", "is_a", "only_a"))
    rows = docs.join(small(wanted), "doc_id").select("doc_id", "text", "fp", "is_a", "only_a")
    return materialise(rows.mapInArrow(cut, "node long, is_a boolean, only_a boolean, frag int, grams array<long>"))


def _fitting(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the wanted similarity and that share enough rare n-grams.

    A linked pair shares at least ``least`` n-grams, so a set lacks at most
    ``n - least`` of its own in the other, also among its rare ones.
    ``lists`` has (node, n, hs).
    """
    side = lambda x: lists.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("hs").alias(f"h{x}"))
    sized = (pairs.join(side("a"), "a").join(side("b"), "b")
             .filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
             .withColumn("k", F.size(F.array_intersect("ha", "hb"))))
    least = f"(({percent} * (na + nb) + {99 + percent}) DIV {100 + percent})"
    spare = lambda n: f"{least} - ({percent} * {n} + 99) DIV 100 + least({SHARED}, ({percent} * {n} + 99) DIV 100)"
    return sized.filter(f"k >= least({spare('na')}, {spare('nb')})").select("a", "b", "na", "nb")


def overlaps(pairs: DataFrame, pieces_of, percent: int) -> DataFrame:
    """Pairs (a, b) whose summed partial overlaps reach the threshold.

    Only the sets that a pair needs are cut and travel.
    """
    pairs = materialise(pairs)
    ends = (pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("first")),
                                           F.struct(F.col("b").alias("node"), F.lit(False).alias("first")))).alias("e"))
            .groupBy("e.node").agg(F.max("e.first").alias("is_a"), F.min("e.first").alias("only_a")))
    pieces = pieces_of(ends)
    right = pieces.filter("NOT only_a").select(F.col("node").alias("b"), "frag", F.col("grams").alias("gb"))
    left = pieces.filter("is_a").select(F.col("node").alias("a"), "frag", F.col("grams").alias("ga"))
    return (pairs.join(right, "b").join(left, ["a", "frag"])
            .select("a", "b", "na", "nb", "frag", F.size(F.array_intersect("ga", "gb")).alias("part"))
            .groupBy("a", "b", "na", "nb", "frag").agg(F.max("part").alias("part"))  # repeated rows count once
            .groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
            .filter(f"100 * both >= {percent} * (na + nb - both)").select("a", "b"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose doc_id is the smallest of its component (or null)."""
    found = link(docs.select("doc_id", "text"), **options)
    drop = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("__drop")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["__drop"], "left_anti")
