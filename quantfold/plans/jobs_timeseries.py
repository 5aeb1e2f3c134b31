"""Registered window / time-series jobs: f01–f10, f12–f15, f17, d06, d09, d10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import timeseries as ts
from .registry import register
from .sqlviews import with_views

RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@register("f01_lead_target", with_views(["panel_customer"], """
SELECT company, date, round(market_cap, 6) AS market_cap,
       round(lead(market_cap) OVER (PARTITION BY company ORDER BY date), 6) AS market_cap_forecast
FROM panel_customer"""))
def f01(t):
    """Next-period market cap per company (the model target)."""
    p = t.panel("customer").select("company", "date", "market_cap")
    return ts.lead_by(p, "company", "date", "market_cap", 1, "market_cap_forecast")


@register("f02_lag", with_views(["panel_customer"], """
SELECT company, date, round(market_cap, 6) AS market_cap,
       round(lag(market_cap) OVER (PARTITION BY company ORDER BY date), 6) AS market_cap_lag,
       round(lag(market_cap, 2) OVER (PARTITION BY company ORDER BY date), 6) AS market_cap_lag2
FROM panel_customer"""))
def f02(t):
    """Previous-period (lag 1 and lag 2) market cap per company."""
    p = t.panel("customer").select("company", "date", "market_cap")
    p = ts.lag_by(p, "company", "date", "market_cap", 1, "market_cap_lag")
    return ts.lag_by(p, "company", "date", "market_cap", 2, "market_cap_lag2")


@register("f03_pct_change", with_views(["prices"], """
SELECT ticker, date, round(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS ret
FROM prices"""))
def f03(t):
    """Daily return per ticker, gaps padded with the last close."""
    return ts.pct_change(t.prices_once, "ticker", "date", "close", "ret").select("ticker", "date", "ret")


@register("f04_cum_index", with_views(["prices"], f"""
SELECT ticker, date,
       round(coalesce(last_value(close IGNORE NULLS) OVER w / first_value(close IGNORE NULLS) OVER w, 1.0), 6) AS growth
FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date {RUNNING})"""))
def f04(t):
    """Cumulative growth index per ticker (1 before listing)."""
    return ts.cum_index(t.prices_once, "ticker", "date", "close", "growth").select("ticker", "date", "growth")


@register("f04_cum_index_product", with_views(["prices"], f"""
SELECT ticker, date, round(coalesce(product(1 + ret) OVER (PARTITION BY ticker ORDER BY date {RUNNING}), 1.0), 6) AS growth
FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM prices)"""))
def f04_product(t):
    """Cumulative growth as the literal running product of (1 + return)."""
    r = ts.pct_change(t.prices_once, "ticker", "date", "close", "ret")
    return ts.cum_index_product(r, "ticker", "date", "ret", "growth").select("ticker", "date", "growth")


@register("f05_expanding_std", with_views(["prices"], f"""
SELECT ticker, date, round(stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY date {RUNNING}), 6) AS rolling_std
FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM prices)"""))
def f05(t):
    """Expanding sample std of daily returns per ticker (one pass, no rescans)."""
    r = ts.pct_change(t.prices_once, "ticker", "date", "close", "ret")
    return ts.expanding_std(r, "ticker", "date", "ret", "rolling_std").select("ticker", "date", "rolling_std")


MONTHLY = """SELECT series, last_day(obs_date) AS date, value FROM (
  SELECT series, obs_date, value, row_number() OVER (PARTITION BY series, last_day(obs_date)
                                                    ORDER BY obs_date DESC, obs_id DESC) AS rn
  FROM macro_obs WHERE value IS NOT NULL) WHERE rn = 1"""


@register("f07_monthly_last", with_views(["macro_obs"], MONTHLY))
def f07(t):
    """Last observation of each month per series (month-end dated)."""
    return ts.monthly_last(t.macro_obs, "series", "obs_date", "value", "obs_id").select("series", "date", "value")


MONTH_SPINE = f"""SELECT s.series, last_day(s.lo + to_months(CAST(i AS INTEGER))) AS date
  FROM (SELECT series, min(date) AS lo, max(date) AS hi FROM ({MONTHLY}) GROUP BY series) s,
       range(0, date_diff('month', s.lo, s.hi) + 1) r(i)"""


@register("f06_forward_fill", with_views(["macro_obs"], f"""
SELECT sp.series, sp.date, m.value AS raw_value,
       last_value(m.value IGNORE NULLS) OVER (PARTITION BY sp.series ORDER BY sp.date {RUNNING}) AS value
FROM ({MONTH_SPINE}) sp LEFT JOIN ({MONTHLY}) m USING (series, date)"""))
def f06(t):
    """Monthly series reindexed on a month spine, gaps forward-filled within a series."""
    m = ts.monthly_last(t.macro_obs, "series", "obs_date", "value", "obs_id")
    r = ts.reindex(m, "series", "date", 1).withColumn("raw_value", F.col("value"))
    return ts.forward_fill(r, "series", "date", ["value"]).select("series", "date", "raw_value", "value")


@register("f08_snap_period_end", """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS d,
  CASE WHEN month(o_orderdate) IN (5, 6) THEN make_date(year(o_orderdate), 6, 30)
       WHEN month(o_orderdate) IN (11, 12) THEN make_date(year(o_orderdate), 12, 31)
       ELSE CAST(o_orderdate AS DATE) END AS report_date,
  last_day(CAST(o_orderdate AS DATE)) AS month_end
FROM orders""")
def f08(t):
    """Reporting-date snap (May/Jun, Nov/Dec) and month-end snap of every order date."""
    d = t.orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select("d", D.snap_report_date("d").alias("report_date"), D.month_end("d").alias("month_end"))


@register("f09_half_year_calendar", with_views(["panel"], """
SELECT company, date AS period,
       last_day(DATE '2023-06-30' - to_months(CAST(6 * (row_number() OVER (PARTITION BY company ORDER BY date DESC) - 1) AS INTEGER))) AS date
FROM panel"""))
def f09(t):
    """Positional half-year calendar counted back from 2023-06-30 per company."""
    p = t.panel("nation").select("company", F.col("date").alias("period"))
    return ts.half_year_calendar(p, "company", "period", "2023-06-30", "date")


@register("f10_shift_six_months", with_views(["panel"], """
SELECT DISTINCT date, last_day(date - INTERVAL 6 MONTH) AS shifted FROM panel"""))
def f10(t):
    """Half-year dates moved back six months to the month end."""
    d = t.panel("nation").select("date").distinct()
    return ts.shift_months_to_month_end(d, "date", 6, "shifted")


@register("f12_first_occurrence", with_views(["doc_pages"], """
SELECT report_id, page_no,
       CASE WHEN row_number() OVER (PARTITION BY content ORDER BY report_id, page_no) = 1 THEN md5(content) END AS content_md5
FROM doc_pages"""))
def f12(t):
    """Blank every repeat of a page text after its first occurrence (hash shown)."""
    b = ts.blank_repeats(t.doc_pages, "content", ["report_id", "page_no"], "first_content")
    return b.select("report_id", "page_no", F.md5("first_content").alias("content_md5"))


@register("f13_extend_spine", with_views(["panel"], """
SELECT s.company, last_day(s.lo + to_months(CAST(6 * i AS INTEGER))) AS date
FROM (SELECT company, min(date) AS lo, max(date) AS hi FROM panel GROUP BY company) s,
     range(0, CAST(date_diff('month', s.lo, s.hi) / 6 AS BIGINT) + 3) r(i)"""))
def f13(t):
    """Half-year spine per company extended two periods past its last row."""
    return ts.calendar_spine(t.panel("nation"), "company", "date", 6, extend=2)


@register("f14_skip_first", with_views(["panel_customer"], """
SELECT company, date, round(market_cap, 6) AS market_cap FROM (
  SELECT company, date, market_cap, row_number() OVER (PARTITION BY company ORDER BY date) AS rn
  FROM panel_customer) WHERE rn > 3"""))
def f14(t):
    """Drop the first three periods of every company."""
    p = t.panel("customer").select("company", "date", "market_cap")
    return ts.skip_first(p, "company", "date", 3)


@register("f15_first_valid", with_views(["prices"], """
SELECT ticker, min(date) FILTER (WHERE close IS NOT NULL) AS first_valid FROM prices GROUP BY ticker"""))
def f15(t):
    """First date with a price per ticker."""
    return ts.first_valid_date(t.prices_once, "ticker", "date", "close")


@register("f17_distance_from_max", with_views(["panel_customer"], f"""
SELECT company, date,
       round(max(market_cap) OVER (PARTITION BY company) - market_cap, 6) AS change_ath,
       round(max(market_cap) OVER (PARTITION BY company ORDER BY date {RUNNING}) - market_cap, 6) AS change_running_max
FROM panel_customer"""))
def f17(t):
    """Distance from the whole-history max (parity) and from the running max."""
    p = t.panel("customer").select("company", "date", "market_cap")
    p = ts.distance_from_max(p, "company", "date", "market_cap", "change_ath", lookahead=True)
    p = ts.distance_from_max(p, "company", "date", "market_cap", "change_running_max", lookahead=False)
    return p.drop("market_cap")


@register("d06_asof_attach", with_views(["panel_customer"], """
SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS order_date, p.date AS panel_date, round(p.market_cap, 6) AS market_cap
FROM orders o ASOF LEFT JOIN panel_customer p
  ON o.o_custkey = p.company AND CAST(o.o_orderdate AS DATE) >= p.date"""))
def d06(t):
    """Latest half-year panel row at or before each order's date (backward as-of)."""
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("company"),
                        F.to_date("o_orderdate").alias("order_date"))
    from ..session import reuse
    # the half-year panel (customers × periods) is read twice by the as-of join: keep it
    p = reuse(t.panel("customer").select("company", F.col("date").alias("panel_date"), "market_cap",
                                               F.col("date").alias("panel_date_key")))
    r = ts.asof_backward(o, p, "company", "order_date", "panel_date_key", ["panel_date", "market_cap"])
    return r.select("o_orderkey", "order_date", "panel_date", "market_cap")


REGION_COLS = [("AFRICA", "africa"), ("AMERICA", "america"), ("ASIA", "asia"),
               ("EUROPE", "europe"), ("MIDDLE EAST", "middle_east")]


def region_series(t):
    """Series list for a pivot: read from the (small, fixed-size) region dimension."""
    names = sorted(r[0] for r in t.region.select("r_name").collect())
    return names, [n.lower().replace(" ", "_") for n in names]


@register("d09_outer_align", with_views(["macro_obs"], f"""
SELECT date, {', '.join(f"max(value) FILTER (WHERE series = '{s}') AS {c}" for s, c in REGION_COLS)}
FROM ({MONTHLY}) GROUP BY date"""))
def d09(t):
    """Monthly series of every region aligned on one date column (outer)."""
    names, cols = region_series(t)
    m = ts.monthly_last(t.macro_obs, "series", "obs_date", "value", "obs_id")
    return ts.align_series(m, "date", "series", "value", names, cols)


@register("d10_reindex_calendar", with_views(["panel_customer"], """
SELECT s.company, s.date, round(p.market_cap, 6) AS market_cap FROM (
  SELECT g.company, last_day(g.lo + to_months(CAST(6 * i AS INTEGER))) AS date
  FROM (SELECT company, min(date) AS lo, max(date) AS hi FROM panel_customer GROUP BY company) g,
       range(0, CAST(date_diff('month', g.lo, g.hi) / 6 AS BIGINT) + 1) r(i)) s
LEFT JOIN panel_customer p USING (company, date)"""))
def d10(t):
    """Each company's rows on its full half-year calendar; missing periods are NULL rows."""
    p = t.panel("customer").select("company", "date", "market_cap")
    return ts.reindex(p, "company", "date", 6).select("company", "date", "market_cap")
