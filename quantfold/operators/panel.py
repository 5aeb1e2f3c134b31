"""Panel operators: column maintenance, filters, reshape, joins, aggregations.

Statements stay *long* — (company, sheet, item, period, value) — until the
very end; renames, drops, de-duplication and zero-share pruning are then
row filters and small semi/anti joins instead of per-column driver loops,
and the final wide panel is a single pivot over a supplied item list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions._util import as_col
from ..functions.nulls import dash_to_zero, lossy_double, ne_keep_null, safe_div
from ..session import cut_lineage
from .quantiles import exact_quantiles


# ---- b01 / b02 / b03 / b25 ---------------------------------------------------
def rename_items(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """b01: rename values of ``col`` through a synonym map (many-to-one allowed).

    The map is a literal ``map`` expression: it is part of the code, fixed in
    size, so no join or broadcast is needed.
    """
    if not mapping:
        return df
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(col, F.coalesce(m[F.col(col)], F.col(col)))


def title_case(c) -> Column:
    """b02: Python-style title case: every letter run starts upper, rest lower.

    Plain ``initcap`` only capitalises after spaces ("Ebit/trading");
    here a letter run after any non-letter is capitalised ("Ebit/Trading").
    """
    runs = F.regexp_extract_all(as_col(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    cap = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30))))
    return F.array_join(cap, "")


def drop_items(df: DataFrame, col: str, items: Sequence[str]) -> DataFrame:
    """b03 (long form): drop rows whose item is in a fixed list (pushed-down NOT IN)."""
    return df.where(~F.col(col).isin(list(items)))


def split_key(c, sep: str, i: int) -> Column:
    """b25: i-th field (0-based) of a composite string key."""
    return F.split(as_col(c), F.lit(sep)).getItem(i)


# ---- b04 / b13 / b14 / b15 / b21 / b23 / b24 ------------------------------------
def keep_not_equal(df: DataFrame, col: str, value) -> DataFrame:
    """b04: ``col != value`` keeping NULL rows."""
    return df.where(ne_keep_null(col, value))


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """b13: drop rows with a NULL in any (or the listed) column."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def clean_numeric_text(df: DataFrame, col: str, out: str, token: str = "--") -> DataFrame:
    """b14: textual null token -> 0, then a lossy cast (bad text -> NULL)."""
    return df.withColumn(out, lossy_double(dash_to_zero(col, token)))


def patch_latest(df: DataFrame, date_col: str, col: str, value) -> DataFrame:
    """b15: set ``col`` on the latest date's rows; latest date is a scalar subquery."""
    latest = df.select(F.max(date_col)).scalar()
    return df.withColumn(col, F.when(F.col(date_col) == latest, F.lit(value)).otherwise(F.col(col)))


def drop_every_nth(df: DataFrame, keys, order, n: int = 2, where: Column | None = None) -> DataFrame:
    """b21: drop rows 1, 1+n, 1+2n, ... (in order) of each key, optionally only where ``where``.

    Rows per key are periods of one company, so each window group is small.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order)))
    victim = ((F.col("__rn") - 1) % n) == 0
    if where is not None:
        victim = victim & where
    return df.withColumn("__rn", rn).where(~victim).drop("__rn")


def zero_share_items(df: DataFrame, item_col: str, value_col: str, threshold: float = 0.5) -> DataFrame:
    """b23: items whose share of zero values exceeds ``threshold`` (one aggregation pass)."""
    share = F.avg(F.when(F.col(value_col) == 0, 1.0).otherwise(0.0))
    return df.groupBy(item_col).agg(share.alias("zero_share")).where(F.col("zero_share") > threshold)


def drop_mostly_zero(df: DataFrame, item_col: str, value_col: str, threshold: float = 0.5) -> DataFrame:
    """b23: remove items that are mostly zero — an anti join with the small item list."""
    return df.join(zero_share_items(df, item_col, value_col, threshold).select(item_col), item_col, "left_anti")


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """b24: NULL count per column, one aggregate then unpivoted to (column, nulls)."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "nulls")


def every_kth_and_last(df: DataFrame, order: str, k: int = 20) -> DataFrame:
    """b22: rows k, 2k, ... (0-based positions, not the first) plus the last row.

    Runs over per-date curve rows (one row per date), where an unpartitioned
    window is a few thousand rows at most.
    """
    n = df.select(F.count(F.lit(1))).scalar()
    rn = F.col("__rn")
    return (df.withColumn("__rn", F.row_number().over(Window.orderBy(order)) - 1)
              .where((((rn % k) == 0) & (rn != 0)) | (rn == n - 1)).drop("__rn"))


# ---- c01 / c02 / c03 / c04 -------------------------------------------------------
def pivot_items(df: DataFrame, keys: Sequence[str], item_col: str, value_col: str,
                items: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """c01/d01: long -> wide with a supplied item list (one two-phase aggregate)."""
    wide = df.groupBy(*keys).pivot(item_col, list(items)).agg(F.first(value_col, ignorenulls=True))
    if names:
        wide = wide.withColumnsRenamed(dict(zip(items, names)))
    return wide


def stack_columns(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                  name: str = "item", value: str = "value") -> DataFrame:
    """c02: wide -> long (unpivot) keeping the keys."""
    return df.unpivot(list(keys), list(cols), name, value)


def first_wins(df: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    """c03: keep one row per key, the one with the lowest ``rank`` (first wins)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(rank))
    return df.withColumn("__rn", rn).where(F.col("__rn") == 1).drop("__rn")


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """c04/c05: union by column name; columns missing on one side become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ---- e01 / e02 --------------------------------------------------------------------
def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """e01: Pearson r of every column pair a < b, all pairs in ONE aggregate.

    NULL (not an error) for a constant column: ANSI ``corr`` raises there,
    so r = covar_pop / (stddev_pop · stddev_pop) over rows where both exist.
    """
    cols = list(cols)
    aggs = []
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        r = safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")).alias(f"p{i}"))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("p")).select("p.*")


def correlated_pairs(corr: DataFrame, threshold: float = 0.75) -> DataFrame:
    """e02: pairs with |r| above the threshold."""
    return corr.where(F.abs("r") > threshold)


def correlated_drop_list(corr: DataFrame, columns: Sequence[str], threshold: float = 0.75) -> DataFrame:
    """e02: greedy drop list over the columns in their order.

    A column is dropped when it correlates above the threshold with an earlier
    column that was itself kept, so of a~b, b~c only b goes. The recursion
    walks the ordered columns once; its state is the list of survivors.
    """
    spark = corr.sparkSession
    columns = list(columns)
    tag = f"__corr_{uuid4().hex}"
    # at most p * p / 2 pairs: one row that holds every column's earlier partners
    pairs = correlated_pairs(corr, threshold)
    partners = pairs.select(F.col("a").alias("e"), F.col("b").alias("l")).unionByName(
        pairs.select(F.col("b").alias("e"), F.col("a").alias("l")))
    place = F.create_map(*[v for i, c in enumerate(columns) for v in (F.lit(c), F.lit(i))])
    ordered = (partners.select("e", "l", place[F.col("e")].alias("i"), place[F.col("l")].alias("j")).where("i < j")
               .groupBy("j").agg(F.collect_set("e").alias("earlier")))
    steps = spark.createDataFrame(list(enumerate(columns)), "i int, name string").join(
        ordered, F.col("i") == F.col("j"), "left").select("i", "name", F.coalesce("earlier", F.array().cast("array<string>")).alias("earlier"))
    cut_lineage(steps).createOrReplaceTempView(tag)
    try:
        walked = spark.sql(f"""
            WITH RECURSIVE walk(i, kept, dropped) MAX RECURSION LEVEL {len(columns) + 1} AS (
              SELECT CAST(-1 AS INT), CAST(array() AS ARRAY<STRING>), CAST(NULL AS STRING)
              UNION ALL
              SELECT s.i, CASE WHEN arrays_overlap(w.kept, s.earlier) THEN w.kept ELSE array_append(w.kept, s.name) END,
                     CASE WHEN arrays_overlap(w.kept, s.earlier) THEN s.name END
              FROM walk w JOIN {tag} s ON s.i = w.i + 1)
            SELECT dropped AS `column` FROM walk WHERE dropped IS NOT NULL""")
        return cut_lineage(walked)
    finally:
        spark.catalog.dropTempView(tag)


# ---- e09 / i03 -----------------------------------------------------------------------
def quartile_edges(df: DataFrame, col: str) -> DataFrame:
    """e09: exact quartile edges (linear interpolation, as pandas) as one row (e1, e2, e3)."""
    return exact_quantiles(df, col, (0.25, 0.5, 0.75), ("e1", "e2", "e3"))


def quartile_label(df: DataFrame, col: str, out: str = "quartile") -> DataFrame:
    """e09: Q1..Q4 label, right-closed bins, lowest value in Q1 (pandas qcut)."""
    edges = quartile_edges(df, col).first()  # three numbers; none where the column has no value
    x = F.col(col)
    if edges is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    lab = F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(None))
    for name, edge in zip(("Q1", "Q2", "Q3"), edges):
        lab = lab.when(x <= edge, name)
    return df.withColumn(out, lab.otherwise("Q4"))


def quartile_dummies(df: DataFrame, col: str, prefix: str = "quartile_") -> DataFrame:
    """i03: quartile dummies Q2..Q4 (first dropped) as 0/1 integers."""
    lab = quartile_label(df, col, "__q")
    return lab.withColumns({f"{prefix}q{i}": F.when(F.col("__q") == f"Q{i}", 1).otherwise(0)
                            for i in (2, 3, 4)}).drop("__q")


# ---- e12 / e13 ---------------------------------------------------------------------
def group_means(df: DataFrame, keys, cols: Sequence[str]) -> DataFrame:
    """e12: per-key means."""
    return df.groupBy(keys).agg(*[F.avg(c).alias(c) for c in cols])


def last_per_column(df: DataFrame, keys, order: str, cols: Sequence[str]) -> DataFrame:
    """e13: last non-null value of every column per key (pandas ``groupby.last``)."""
    return df.groupBy(keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
                                  for c in cols])
