"""Quality rules with adaptive thresholds, in native expressions only.

Every text gets counts and five measures. A measure's usual range is learned
per language and source from a **mergeable quantile sketch**: a grid of
integer cells with counts, built with partial aggregates and merged by adding
counts (source into language into all). The sketch is deterministic, whatever
the order of merging, and errs by one cell at most. A group of fewer than
``min_rows`` documents uses its language's merged sketch, a small language the
sketch of everything.

The allowed range is ``[q25 - k IQR - margin, q75 + k IQR + margin]``, widened
by ``noise / sqrt(n_words)`` because short texts vary more. The thresholds are
one row per language and source and are joined to the documents; a document is
kept when the base rules pass and every measure is inside its range.

Measures (cells): share of symbols, of repeated lines, of repeated words and
of capital letters (1024ths; only too high fails), and mean word length
(64ths up to 64 letters, then 64 cells for each doubling without an end; too
low or too high fails). Limits are set in the measures' own units.

Edge cases: a null or wordless text has zero counts and fails the base rule.
Null language or source is a group of its own. An empty table gives no rows.
Repeated rows are judged alike. The hash of a five-word window stands for
the window. Extra columns are not returned by ``measure``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import SPACE, materialise

#: name -> (numerator, denominator, cells a unit, margin in units, noise, checks the low side)
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 1024, 0.02, 0.1, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1024, 0.35, 0.0, False),
    "repeats": ("n_repeat_words", "n_words", 1024, 0.12, 0.0, False),
    "capitals": ("n_upper", "word_chars", 1024, 0.2, 1.0, False),
    "word_length": ("word_chars", "n_words", 64, 1.0, 6.0, True),
}
#: Cells below this are exact; from here on each doubling has 64.
FINE = 4096
_TRIMMED = " \t\n\x0b\x0c\r"
_N = 5


def _repeated_words(grams: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    placed = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    o = F.col("__placed")
    hit = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda j: F.coalesce(
        (F.get(o, j)["h"] == F.get(o, j - 1)["h"]) & (j > 0), F.lit(False)) | F.coalesce(
        F.get(o, j)["h"] == F.get(o, j + 1)["h"], F.lit(False)))
    at = F.array_sort(F.transform(hit, lambda j: F.get(o, j)["i"]))
    p = F.col("__at")
    covered = F.lit(_N) + F.aggregate(
        F.sequence(F.lit(0), F.size(p) - 1), F.lit(0),
        lambda acc, k: acc + F.when(F.get(p, k + 1).isNull(), 0).otherwise(F.least(F.lit(_N), F.get(p, k + 1) - F.get(p, k))))
    return placed, at, covered


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the counts of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_TRIMMED))
    a = docs.select(*keep, text.alias("__text"),
                    F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>")).alias("__w"))
    w = F.col("__w")
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(_TRIMMED))) > 0)
    b = a.select(*keep, F.size(w).cast("long").alias("n_words"),
                 F.length(F.regexp_replace("__text", SPACE, "")).cast("long").alias("word_chars"),
                 F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                 F.regexp_count("__text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
                 lines.alias("__lines"),
                 F.when(F.size(w) >= _N, F.transform(
                     F.sequence(F.lit(0), F.size(w) - _N),
                     lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(_N)]))).alias("__grams"))
    repeated = F.coalesce(F.size(F.array_distinct("__grams")) < F.size("__grams"), F.lit(False))
    c = b.select("*", F.size("__lines").cast("long").alias("n_lines"),
                 (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
                 F.when(repeated, F.col("__grams")).alias("__r"))
    placed, at, covered = _repeated_words(F.col("__r"))
    d = c.withColumn("__placed", F.when(F.col("__r").isNotNull(), placed))
    d = d.withColumn("__at", F.when(F.col("__r").isNotNull(), at))
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    F.when(F.col("__r").isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
                    "n_upper", "n_lines")


def _cell(name: str) -> Column:
    top, bottom, cells, *_ = MEASURES[name]
    exact = f"CASE WHEN {bottom} > 0 THEN {cells} * {top} DIV {bottom} ELSE 0L END"
    doublings = f"(length(bin({exact})) - {FINE.bit_length()})"
    return F.expr(f"CASE WHEN {exact} < {FINE} THEN {exact} ELSE "
                  f"{FINE}L + 64 * {doublings} + (shiftright({exact}, {doublings}) - {FINE}) DIV 64 END")


def _edge(cell: str) -> Column:
    """The smallest number of 1024ths or 64ths that falls into a cell."""
    return F.expr(f"CASE WHEN {cell} < {FINE} THEN {cell} ELSE shiftleft({FINE}L + 64 * (({cell} - {FINE}) % 64), "
                  f"CAST(({cell} - {FINE}) DIV 64 AS INT)) END")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, cell, n): the sketch of every group and measure."""
    stacked = measured.filter("n_words > 0").select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), _cell(m).alias("cell")) for m in MEASURES])).alias("m"))
    return stacked.groupBy("lang", "source", "m.measure", "m.cell").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """q25, q75 (cells) and rows of each group of a sketch after merging it to ``keys``."""
    merged = sketch.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure").orderBy("cell")
    run = merged.withColumn("upto", F.sum("n").over(w)).withColumn(
        "rows", F.sum("n").over(Window.partitionBy(*keys, "measure")))
    return run.groupBy(*keys, "measure").agg(
        F.max("rows").alias(f"rows_{tag}"),
        F.min(F.when(F.col("upto") * 4 >= F.col("rows"), F.col("cell"))).alias(f"lo_{tag}"),
        F.min(F.when(F.col("upto") * 4 >= F.col("rows") * 3, F.col("cell"))).alias(f"hi_{tag}"))


def thresholds(measured: DataFrame, *, k: float = 4.0, min_rows: int = 200) -> DataFrame:
    """One row per (lang, source): ``<measure>_lo`` and ``<measure>_hi`` in units."""
    sketch = materialise(sketches(measured))
    own = _quartiles(sketch, ["lang", "source"], "own")
    lang = _quartiles(sketch, ["lang"], "lang")
    everything = _quartiles(sketch, [], "all")
    joined = (own.alias("o").join(lang.alias("l"), F.expr("o.lang <=> l.lang AND o.measure = l.measure"))
              .join(everything.alias("e"), F.expr("o.measure = e.measure"))
              .select("o.lang", "o.source", "o.measure",
                      *[F.expr(f"CASE WHEN rows_own >= {min_rows} THEN {q}_own WHEN rows_lang >= {min_rows} "
                               f"THEN {q}_lang ELSE {q}_all END").alias(q) for q in ("lo", "hi")]))
    aggs = []
    for m, (_, _, cells, margin, _, low) in MEASURES.items():
        here, hi, lo = F.col("measure") == m, _edge("hi"), _edge("lo")
        aggs.append(F.max(F.when(here, (hi + k * (hi - lo)) / cells + margin)).alias(f"{m}_hi"))
        if low:
            aggs.append(F.max(F.when(here, (lo - k * (hi - lo)) / cells - margin)).alias(f"{m}_lo"))
    return joined.groupBy("lang", "source").agg(*aggs)


def judge(docs: DataFrame, *, k: float = 4.0, min_rows: int = 200) -> DataFrame:
    """doc_id, lang, source, the counts, ``base_failed``, ``failed`` (measures out of range) and ``kept``."""
    measured = materialise(measure(docs, "doc_id", "lang", "source"))
    limits = thresholds(measured, k=k, min_rows=min_rows)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = []
    for m, (top, bottom, _, _, noise, low) in MEASURES.items():
        value = F.col(top) / F.when(F.col(bottom) > 0, F.col(bottom))
        slack = F.lit(noise) / F.sqrt(F.greatest("n_words", F.lit(1)).cast("double"))
        out = value > F.col(f"{m}_hi") + slack
        if low:
            out = out | (value < F.col(f"{m}_lo") - slack)
        failed.append(F.when(F.coalesce(out, F.lit(False)), F.lit(m)))
    joined = measured.alias("d").join(
        limits.withColumnsRenamed({"lang": "__l", "source": "__s"}),
        F.expr("d.lang <=> __l AND d.source <=> __s"), "left")
    return joined.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base.alias("base_failed"), F.array_compact(F.array(*failed)).alias("failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0))
