"""Exact order statistics without a sort of the whole column (e09, i03, e08, j03).

A wanted quantile is the rank ``(n - 1) q``, interpolated between the values
at its floor and ceiling. The open interval of a rank starts as [min, max].
While more than ``most`` rows lie in some interval, one aggregate counts the
rows of every interval in ``buckets`` equal steps, with each step's smallest
and largest value, and the rank moves into its step. Steps are disjoint, and
a step of equal values is closed at once, so a value that fills the column
costs one count. What is left of an interval is counted by distinct value and
numbered; no task ever holds more than ``most`` or ``buckets`` rows of a key.

Every pass is a hash aggregate with partial sums on the map side, so a key
with a third of all rows is not a hot key. NULL and NaN are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import nan_to_null
from ..session import cut_lineage

#: Intervals of a pass that may be broadcast (a few numbers each); more of them take a shuffled join.
BROADCAST_INTERVALS = 10_000
LARGEST = sys.float_info.max
_SPAN = ["__lo", "__hi"]


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.expr(f"{a}.`{n}` <=> {b}.`{n}`")
    return cond


def _inside(rows: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` that lie in an open interval of their key, with the interval."""
    spans = cut_lineage(ranks.where("__lo < __hi").select(*keys, *_SPAN).distinct())
    if spans.count() <= BROADCAST_INTERVALS:
        spans = F.broadcast(spans)
    on = _same("r", "s", keys) & F.expr("r.__x BETWEEN s.__lo AND s.__hi")
    return rows.alias("r").join(spans.alias("s"), on).select("r.*", "s.__lo", "s.__hi")


def _located(ranks: DataFrame, steps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Open ranks moved into the one of ``steps`` (keys, span, order, n, from, to) that holds them."""
    w = Window.partitionBy(*keys, *_SPAN).orderBy(order)
    cut = steps.withColumn("__before", F.sum("__m").over(w) - F.col("__m"))
    return (ranks.where("__lo < __hi").alias("r").join(cut.alias("c"), _same("r", "c", [*keys, *_SPAN])
                                                       & F.expr("r.__k >= c.__before AND r.__k < c.__before + c.__m"))
            .select(*[F.col(f"r.`{k}`") for k in keys], "r.__q", "r.__up", "r.__share",
                    (F.col("__k") - F.col("__before")).alias("__k"), F.col("__from").alias("__lo"), F.col("__to").alias("__hi"),
                    F.col("c.__m").alias("__n")))


def _narrowed(rows: DataFrame, ranks: DataFrame, keys: list[str], most: int, buckets: int) -> DataFrame:
    """``ranks`` with the value of their row as both ends of their interval."""
    ranks = cut_lineage(ranks)
    while (ranks.where("__lo < __hi").agg(F.max("__n")).first()[0] or 0) > most:
        x, lo, hi = F.col("__x"), F.col("__lo"), F.col("__hi")
        # halves where the width is beyond the largest double; infinite ends are steps of their own
        part = F.when(hi - lo <= LARGEST, (x - lo) / (hi - lo)).otherwise((x / 2 - lo / 2) / (hi / 2 - lo / 2))
        place = F.when(x == lo, F.lit(0.0)).when(x == hi, F.lit(buckets - 1.0)).otherwise(F.nanvl(part * buckets, F.lit(1.0)))
        steps = (_inside(rows, ranks, keys).withColumn("__step", F.least(F.floor(place), F.lit(buckets - 1).cast("long")))
                 .groupBy(*keys, *_SPAN, "__step")
                 .agg(F.count("*").alias("__m"), F.min("__x").alias("__from"), F.max("__x").alias("__to")))
        ranks = cut_lineage(ranks.where("__lo = __hi").unionByName(_located(ranks, steps, keys, "__step")))
    values = (_inside(rows, ranks, keys).groupBy(*keys, *_SPAN, F.col("__x").alias("__from"))
              .agg(F.count("*").alias("__m")).withColumn("__to", F.col("__from")))
    return ranks.where("__lo = __hi").unionByName(_located(ranks, values, keys, "__from"))


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], names: Sequence[str], keys: Sequence[str] = (),
                    most: int = 100_000, buckets: int = 4096) -> DataFrame:
    """One row per key: the quantiles ``qs`` of ``col`` (linear interpolation) as columns ``names``.

    Keys without a value have no row; without keys and values the table is empty.
    """
    keys = list(keys)
    x = nan_to_null(F.col(col).cast("double"))
    rows = cut_lineage(df.select(*keys, x.alias("__x")).where(F.col("__x").isNotNull()))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    wanted = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(up).alias("up"), ((F.col("__n") - 1) * F.lit(float(q))).alias("at"))
                       for i, q in enumerate(qs) for up in (0, 1)])
    ranks = ends.where("__n > 0").select("*", F.explode(wanted).alias("__w")).select(
        *keys, F.col("__w.q").alias("__q"), F.col("__w.up").alias("__up"), (F.col("__w.at") - F.floor("__w.at")).alias("__share"),
        F.when(F.col("__w.up") == 0, F.floor("__w.at")).otherwise(F.ceil("__w.at")).alias("__k"), "__lo", "__hi", "__n")
    found = _narrowed(rows, ranks, keys, most, buckets)
    at = lambda i, up: F.max(F.when((F.col("__q") == i) & (F.col("__up") == up), F.col("__lo")))
    share = lambda i: F.max(F.when(F.col("__q") == i, F.col("__share")))
    # equal ends (infinite ones too) need no interpolation
    cols = [F.when(at(i, 0) == at(i, 1), at(i, 0)).otherwise(at(i, 0) + (at(i, 1) - at(i, 0)) * share(i)).alias(n)
            for i, n in enumerate(names)]
    out = found.groupBy(*keys).agg(F.count("*").alias("__rows"), *cols)
    return out.where("__rows > 0").drop("__rows")


def value_at(df: DataFrame, col: str, position: int, most: int = 100_000, buckets: int = 4096) -> float:
    """The value at 0-based ``position`` of the ascending order of ``col`` (no NULL or NaN in it)."""
    rows = df.select(F.col(col).cast("double").alias("__x"))
    ends = rows.agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    ranks = ends.select(F.lit(0).alias("__q"), F.lit(0).alias("__up"), F.lit(0.0).alias("__share"),
                        F.lit(position).cast("long").alias("__k"), "__lo", "__hi", "__n")
    return _narrowed(rows, ranks, [], most, buckets).first()["__lo"]
