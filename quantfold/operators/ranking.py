"""Exact numbers and top shares of large tables without a single-task window (a06, a11, g02, h18).

``numbered`` moves a table once: it is range-partitioned on (keys, order) and
sorted, and every row carries its partition and place in one long. A row's
number is its place among its key's rows of the partition plus the rows of
that key in earlier partitions, which is a table of one row per key and
partition. A key with nine tenths of all rows is spread over its range.

``top_rows`` does not sort at all: the score of the last row that belongs is
an exact order statistic, and only rows tied with it are numbered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quantiles import value_at

#: Offsets (key, partition, two numbers) that may be broadcast; more of them take a join on key and partition.
BROADCAST_OFFSETS = 100_000
_PLACE_BITS = 33  # of ``monotonically_increasing_id``


def numbered(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "rank",
             total: str | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with the 1-based number of each row within its key, by ``order``; ``total`` names a column of the key's rows.

    ``order`` should be unique inside a key (equal rows are numbered in any
    order). NULL is a key like any other. The result's partitions are in
    (keys, order) and so are their rows.
    """
    keys = list(keys)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    placed = cut_lineage(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", _PLACE_BITS), F.col("__id").bitwiseAND((1 << _PLACE_BITS) - 1)
    runs = placed.groupBy(*keys, part.alias("__part")).agg(F.count("*").alias("__n"), F.min(place).alias("__first"))
    # one row per partition and key; without keys one row per partition
    earlier = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")
    whole = F.sum("__n").over(Window.partitionBy(*keys))
    runs = cut_lineage(runs.select(*keys, "__part", (earlier - F.col("__first") + 1).alias("__add"), whole.alias("__whole")))
    small = runs.count() <= BROADCAST_OFFSETS
    if small:
        runs = F.broadcast(runs)
    on = F.expr("d.__part = r.__part")
    for k in keys:
        on = on & F.expr(f"d.`{k}` <=> r.`{k}`")
    out = (placed.withColumns({"__part": part, "__place": place}).alias("d").join(runs.alias("r"), on)
           .select("d.*", (F.col("__place") + F.col("__add")).cast("bigint").alias(name),
                   *([F.col("__whole").cast("bigint").alias(total)] if total else [])).drop("__id", "__part", "__place"))
    if small:
        return out
    sorted_by = [*[F.col(k) for k in keys], F.col(name)]
    return out.repartitionByRange(n, *sorted_by).sortWithinPartitions(*sorted_by)


def top_rows(df: DataFrame, score: str, ties: Sequence[Column], k: int | None = None, fraction: float | None = None) -> DataFrame:
    """The ``k`` (or floor(n · ``fraction``)) rows with the highest score, ties by ``ties``; no order in the result.

    NULL and NaN scores come last. The input is computed once.
    """
    rows = cut_lineage(df)
    value = F.col(score).cast("double")
    scored = value.isNotNull() & ~F.isnan(value)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(scored).alias("scored")).first()
    k = int(sizes["n"] * fraction) if k is None else min(k, sizes["n"])
    if k <= 0:
        return rows.limit(0)
    if k >= sizes["scored"]:
        sure, tied = rows.where(scored), rows.where(~scored)
    else:
        last = value_at(rows.where(scored), score, sizes["scored"] - k)
        sure, tied = rows.where(scored & (value > last)), rows.where(scored & (value == last))
    wanted = k - sure.count()
    if not wanted:
        return sure
    chosen = numbered(tied, ties, name="__rank").where(F.col("__rank") <= wanted).drop("__rank")
    return sure.unionByName(chosen)
