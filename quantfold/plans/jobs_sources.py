"""Registered source/sink jobs: a01–a06, a08–a11 (round trips through the scratch folder)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import portfolio as pf
from ..operators import timeseries as ts
from ..sources import readers as R
from ..sources import sinks as S
from .jobs_panel import MACRO_CTES, macro_sql, macro_wide
from .jobs_portfolio import CURVE_DIGITS, _curve_sql
from .jobs_text import centroid_ctes, sentence_selection
from .jobs_timeseries import MONTHLY, REGION_COLS, region_series
from .registry import ORACLES, register
from .sqlviews import with_views

SERIES = [c for _, c in REGION_COLS]


@register("a01_read_statements", with_views(["statements"], """
SELECT company, sheet, item, period, round(value, 6) AS value FROM statements"""))
def a01(t):
    """Statements written one folder per sheet, read back with a fixed schema and source file."""
    path = S.write_table(t.statements.select("company", "item", "period", "value", "sheet"),
                         S.scratch_path(t.spark, "statements"), partition_by="sheet")
    return R.read_statements(t.spark, path).drop("source_file")


@register("a05_list_files")
def a05(t):
    """Parquet files of a written statements folder, found by suffix (recursive)."""
    path = S.write_table(t.statements.select("company", "item", "period", "value", "sheet"),
                         S.scratch_path(t.spark, "statements"), partition_by="sheet")
    return R.list_files(t.spark, path, ".parquet").select(F.regexp_extract("path", r"sheet=([^/]*)", 1).alias("sheet"), "length")


@register("a02_read_macro_csv", with_views(["macro_obs"], f"""
SELECT date, {', '.join(f'round({c}, 6) AS {c}' for c in SERIES)}, crisis_dummy FROM ({macro_sql()})""", MACRO_CTES))
def a02(t):
    """Quarterly macro panel written as CSV and read back with a typed schema."""
    _, cols = region_series(t)
    path = S.write_csv(macro_wide(t), S.scratch_path(t.spark, "macro_csv"))
    return R.read_macro_csv(t.spark, path, cols)


@register("a03_unpair_series", with_views(["macro_obs"], f"SELECT series, date AS obs_date, round(value, 6) AS value FROM ({MONTHLY})"))
def a03(t):
    """Side-by-side (date, value) column pairs of every series back to long rows."""
    names, _ = region_series(t)
    m = ts.monthly_last(t.macro_obs, "series", "obs_date", "value", "obs_id")
    m = m.withColumn("pos", F.row_number().over(Window.partitionBy("series").orderBy("date")))
    wide = m.groupBy("pos").pivot("series", names).agg(F.first("date").alias("d"), F.first("value").alias("v"))
    pairs = [(n, f"{n}_d", f"{n}_v") for n in names]
    return R.unpair_series(wide, pairs)


@register("a04_read_lines", with_views(["minutes"], f"""
SELECT line FROM (SELECT {__import__('quantfold.plans.jobs_text', fromlist=['sql_clean_minutes']).sql_clean_minutes('content')} AS line FROM minutes)"""))
def a04(t):
    """Cleaned minutes written as a headerless text file and read back line by line."""
    lines = t.minutes.select(T.clean_minutes("content").alias("line"))
    path = S.write_lines(lines, "line", S.scratch_path(t.spark, "minutes_txt"))
    return R.read_lines(t.spark, path)


@register("a06_load_pages", with_views(["doc_pages"], """
SELECT report_id, page_no, CAST(row_number() OVER (PARTITION BY report_id ORDER BY page_no) AS INTEGER) AS page_in_report
FROM doc_pages WHERE content IS NOT NULL AND length(content) > 0"""))
def a06(t):
    """Readable pages with their position in the report (unreadable ones go to a reject output)."""
    readable = (F.col("content").isNotNull() & (F.length("content") > 0)).alias("ok")
    # whether a page is readable is all that numbering needs: the text does not travel
    pages = t.doc_pages.select("report_id", "page_no", F.when(readable, F.lit("x")).alias("content"))
    good, _ = R.load_pages(pages, "report_id", "page_no", "content")
    return good.select("report_id", "page_no", "page_in_report")


@register("a08_sector_members", """
SELECT c_custkey AS code, c_name AS company, c_mktsegment AS sector FROM customer WHERE c_mktsegment = 'AUTOMOBILE'""")
def a08(t):
    """Constituent table -> one sector's members."""
    return R.sector_members(t.companies, "AUTOMOBILE")


@register("a09_csv_sink", _curve_sql("gr.g * pos.inv"), CURVE_DIGITS)
def a09(t):
    """The portfolio curve written as CSV and read back (typed)."""
    c = pf.portfolio_curve(t.forecasts, t.prices, t.index_prices)
    c = c.select("date", *[F.round(x, CURVE_DIGITS.get(x, 6)).alias(x) for x in c.columns[1:]])
    path = S.write_csv(c, S.scratch_path(t.spark, "curve_csv"))
    schema = "date date, portfolio double, benchmark double, portfolio_pct double, benchmark_pct double"
    return t.spark.read.schema(schema).option("header", True).csv(path)


@register("a10_table_sink", with_views(["prices", "forecasts"], """
SELECT ticker, round(market_cap, 6) AS market_cap, round(market_cap_forecast, 6) AS market_cap_forecast,
       'mean_close' AS model FROM forecasts"""))
def a10(t):
    """Forecast table written as parquet partitioned by model and read back."""
    f = t.forecasts.withColumn("model", F.lit("mean_close"))
    path = S.write_table(f, S.scratch_path(t.spark, "forecasts"), partition_by="model")
    return t.spark.read.parquet(path).select("ticker", "market_cap", "market_cap_forecast", "model")


def _a11_sql():
    body = ORACLES["h18_sentence_selection"]
    return f"""SELECT CASE WHEN row_number() OVER (ORDER BY score DESC, sentence) < count(*) OVER ()
                          THEN sentence || '. ' ELSE sentence END AS line FROM ({body})"""


@register("a11_joined_text_sink", _a11_sql())
def a11(t):
    """Selected sentences as one ordered '. '-joined document (one piece per line), read back."""
    sel = sentence_selection(t)
    path = S.write_joined_text(sel, "sentence", [F.col("score").desc(), F.col("sentence")], S.scratch_path(t.spark, "summary"))
    return R.read_lines(t.spark, path)


def _a11_cluster_sql():
    body = ORACLES["h18_sentence_selection"]
    return f"""SELECT CAST(report_id AS VARCHAR) AS cluster, CASE WHEN row_number() OVER (PARTITION BY report_id ORDER BY score DESC, sentence)
        < count(*) OVER (PARTITION BY report_id) THEN sentence || '. ' ELSE sentence END AS line FROM ({body})"""


@register("a11_cluster_texts", _a11_cluster_sql())
def a11_clusters(t):
    """One joined text per group of selected sentences (the report), a folder each, read back."""
    sel = sentence_selection(t)
    path = S.write_cluster_texts(sel, "report_id", "sentence", [F.col("score").desc(), "sentence"], S.scratch_path(t.spark, "clusters"))
    lines = t.spark.read.schema("value string, cluster string").text(path)
    return lines.select("cluster", F.col("value").alias("line"))
