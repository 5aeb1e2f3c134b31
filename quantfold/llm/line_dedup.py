"""Line dedup with content-defined chunks of lines.

1. Every line is hashed. In each of three families a line may start a chunk or
   end one, which two hashes over the line's own hash decide: it starts chunks
   in two families and ends them in two. A chunk runs from a start line to the
   next end line behind it. No line outside a chunk has a say in its
   boundaries, so insertions elsewhere shift nothing; and as two families of
   three always meet two others, any two neighbouring lines are a chunk in some
   family. A single line of ``long_line`` words is a chunk of its own.
2. Chunks are compared by a rolling hash over their line hashes. Those that
   occur again anywhere in the corpus lose all but their first occurrence
   (smallest doc_id, then position).
3. **Byte comparison.** The lines of all repeated chunks are brought together
   by hash, each distinct line once. Should two different lines share a hash,
   everything is done again with another hash, so what is removed has equal
   bytes.
4. Removed lines that stand together are a passage; passages of fewer than
   ``least_words`` words stay (short lines repeat by chance).

The first occurrence of a passage stays: a removed line always has an equal
line earlier in (doc_id, position) order, so some copy of every line survives.

Python looks at ``SLICE_BYTES`` of text at a time, so a task's memory is that
of its longest document. Line numbers and hashes travel for all documents. Texts are moved once, to meet
their spans; a passage that a third of the corpus holds is a row a task there.

Edge cases: null text stays null; an empty text is one empty line. Lines end
at ``\\n`` only; words are counted between blanks. Rows that repeat a doc_id and
text are the same document and are treated alike. Rows without doc_id come
after all others in the order of occurrences, by hash. A document that loses
every line keeps an empty text (``drop_emptied`` leaves such rows out). Extra
columns are kept; ``lines_removed`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import give_back, mix, release, slices, stored

#: Order of rows without doc_id: behind every id.
_LAST = (1 << 63) - 1
_FAMILIES = 3
#: Lines of a chunk; a family without an end line for so long ends here.
_LONGEST = 16
_U = np.uint64


def _doc() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text", F.lit(5)).alias("t")]


def spans(hashes: np.ndarray, long: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, number of lines) of every chunk of some documents, whose lines end at ``bounds``."""
    n = len(hashes)
    end_of_doc = np.repeat(bounds[1:], np.diff(bounds))
    # the one family in which a line starts (ends) nothing
    no_start = (mix(hashes + _U(1)) % _U(_FAMILIES)).astype(np.int64)
    no_end = (mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5)) % _U(_FAMILIES)).astype(np.int64)
    found = [np.flatnonzero(long) * (_LONGEST + 1) + 1]
    for f in range(_FAMILIES):
        start, ends = np.flatnonzero(no_start != f), np.append(np.flatnonzero(no_end != f), n + _LONGEST)
        last = np.minimum(ends[np.searchsorted(ends, start + 1)], start + _LONGEST - 1)
        inside = last < end_of_doc[start]
        found.append(start[inside] * (_LONGEST + 1) + (last - start + 1)[inside])
    span = np.unique(np.concatenate(found))
    return span // (_LONGEST + 1), span % (_LONGEST + 1)


def chunk_hashes(hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rolling hash over the line hashes of every chunk."""
    out = mix(length.astype(np.uint64))
    for k in range(int(length.max(initial=0))):
        on = length > k
        out[on] = mix(out[on] * _U(0xFF51AFD7ED558CCD) + hashes[start[on] + k])
    return out


def chunks(docs: DataFrame, seed: int, long_line: int) -> DataFrame:
    """(d, t, start, len, chunk): every chunk of every document."""
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    lines = docs.filter(F.col("text").isNotNull()).select(*_doc(), F.transform(F.split("text", "\n", -1), lambda x: F.struct(
        F.xxhash64(x, F.lit(seed)).alias("h"), (words(x) >= long_line).alias("long"))).alias("lines"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(2)
            bounds = np.asarray(listed.offsets, np.int64)
            bounds, flat = bounds - bounds[0], listed.flatten()
            hashes = np.asarray(flat.field(0)).view(np.uint64)
            start, length = spans(hashes, np.asarray(flat.field(1).to_numpy(zero_copy_only=False)), bounds)
            row = np.searchsorted(bounds, start, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                 pa.array((start - bounds[row]).astype(np.int32)), pa.array(length.astype(np.int32)),
                 pa.array(chunk_hashes(hashes, start, length).view(np.int64))], names=["d", "t", "start", "len", "chunk"])

    return lines.mapInArrow(cut, "d long, t long, start int, len int, chunk long")


def repeated(found: DataFrame) -> DataFrame:
    """(d, t, spans): the chunks of a document that occur again, each with whether it is a later occurrence."""
    first_doc = found.groupBy("chunk").agg(F.count("*").alias("n"), F.min("d").alias("d0")).filter("n > 1").drop("n")
    again = found.join(first_doc, "chunk").withColumn(
        "place", F.shiftleft(F.shiftrightunsigned("t", 33), 32) + F.col("start"))
    first = again.filter("d = d0").groupBy("chunk").agg(F.min("place").alias("place0"))
    later = again.join(first, "chunk").withColumn("later", ~((F.col("d") == F.col("d0")) & (F.col("place") == F.col("place0"))))
    return later.groupBy("d", "t").agg(F.collect_set(F.struct("start", "len", "later")).alias("spans"))


def _covered(spans_: list[dict], n: int, later: bool) -> list[bool]:
    on = [False] * n
    for s in spans_:
        if s["later"] or not later:
            on[s["start"]:s["start"] + s["len"]] = [True] * s["len"]
    return on


def _repeated_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct lines of repeated chunks, a slice of texts at a time."""
    for batch in batches:
        for lo, hi, _, _ in slices(batch):
            part, seen = batch.slice(lo, hi - lo), set()
            for text, spans_ in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                all_ = text.split("\n")
                seen.update(x for x, on in zip(all_, _covered(spans_, len(all_), False)) if on)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["line"])
        give_back()


def _share_a_hash(marked: DataFrame, seed: int) -> bool:
    """Whether two different lines of repeated chunks have one hash."""
    distinct = marked.filter("__spans IS NOT NULL").select("text", "__spans").mapInArrow(_repeated_lines, "line string").distinct()
    return not distinct.groupBy(F.xxhash64("line", F.lit(seed)).alias("h")).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _remove(spans_: list[dict], text: str, least_words: int) -> tuple[str, int]:
    """The text without its passages, and how many lines went."""
    lines = text.split("\n")
    on = _covered(spans_, len(lines), True)
    i = 0
    while i < len(on):
        if on[i]:
            end = i
            while end < len(on) and on[end]:
                end += 1
            if sum(len(x.split()) for x in lines[i:end]) < least_words:
                on[i:end] = [False] * (end - i)
            i = end
        i += 1
    return "\n".join(x for x, gone in zip(lines, on) if not gone), sum(on)


def _without(names: list[str], least_words: int):
    """Function over Arrow batches of the columns ``names`` and the spans: the texts without their passages, a slice at a time."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in slices(batch):
                part, texts, removed = batch.slice(lo, hi - lo), [], []
                for text, own in zip(part.column(names.index("text")).to_pylist(), part.column(len(names)).to_pylist()):
                    text, n = (text, 0) if own is None else _remove(own, text, least_words)
                    texts.append(text)
                    removed.append(n)
                columns = [pa.array(texts, pa.string()) if n == "text" else part.column(i) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names=[*names, "lines_removed"])
            give_back()
    return apply


def dedup(docs: DataFrame, *, least_words: int = 10, long_line: int = 50, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``, and ``lines_removed``."""
    kept = [f for f in docs.schema.fields if f.name != "lines_removed"]
    names = [f.name for f in kept]
    d, t = _doc()
    seed = 3
    while True:
        found = stored(chunks(docs, seed, long_line))
        spans_ = repeated(found).withColumnsRenamed({"d": "__d", "t": "__t", "spans": "__spans"})
        marked = stored(docs.select(*[F.col(f"`{n}`") for n in names], d.alias("__dk"), t.alias("__tk")).join(
            spans_, (F.col("__dk") == F.col("__d")) & (F.col("__tk") == F.col("__t")), "left")
            .select(*[F.col(f"`{n}`") for n in names], "__spans"))
        if not _share_a_hash(marked, seed):
            break
        seed += 1
    release(docs.sparkSession)

    out = marked.mapInArrow(_without(names, least_words), T.StructType([*kept, T.StructField("lines_removed", T.LongType(), False)]))
    return out.filter("NOT (lines_removed > 0 AND trim(text) = '')") if drop_emptied else out
