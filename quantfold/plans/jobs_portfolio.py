"""Registered portfolio jobs: j01, j02, b17–b20, d05, e05, f16, f18, a07."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import portfolio as pf
from ..operators import timeseries as ts
from ..sources import readers
from .registry import register
from .sqlviews import with_views

# --------------------------------------------------------------------------
# Shared oracle CTEs: the dense ticker x calendar matrix, the literal form of
# the reference computation (fine for DuckDB at test scale).
POS = """SELECT ticker, market_cap, market_cap_forecast, chg,
        CASE WHEN chg >= 0.05 THEN 1000.0 WHEN chg <= -0.05 THEN -1000.0 ELSE 0.0 END::DOUBLE AS inv
     FROM (SELECT ticker, market_cap, market_cap_forecast,
                  market_cap_forecast / nullif(market_cap, 0) - 1 AS chg FROM forecasts)"""
MATRIX = [
    ("pos", POS),
    ("cal", "SELECT date, close AS idx FROM index_prices"),
    ("m", """SELECT c.date, t.ticker, p.close
             FROM cal c CROSS JOIN (SELECT ticker FROM pos WHERE inv <> 0) t
             LEFT JOIN prices p ON p.date = c.date AND p.ticker = t.ticker"""),
    ("gr", """SELECT date, ticker, coalesce(last_value(close IGNORE NULLS) OVER w
                                   / first_value(close IGNORE NULLS) OVER w, 1.0) AS g
              FROM m WINDOW w AS (PARTITION BY ticker ORDER BY date
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    ("net", "SELECT coalesce(sum(inv), 0)::DOUBLE AS net FROM pos"),
    ("d0", "SELECT min(date) AS d0, arg_min(idx, date) AS idx0 FROM cal"),
]


def _curve_sql(value_expr: str) -> str:
    return with_views(["prices", "index_prices", "forecasts"], f"""
SELECT c.date,
       round(CASE WHEN c.date = d0.d0 THEN 0.0 ELSE coalesce(b.book, 0.0) - net.net END, 4) AS portfolio,
       round(CASE WHEN c.date = d0.d0 THEN 0.0 ELSE net.net * (c.idx / d0.idx0 - 1) END, 4) AS benchmark,
       round(CASE WHEN c.date = d0.d0 THEN 0.0 ELSE coalesce(b.book, 0.0) - net.net END / nullif(net.net, 0), 6) AS portfolio_pct,
       round(CASE WHEN c.date = d0.d0 THEN 0.0 ELSE net.net * (c.idx / d0.idx0 - 1) END / nullif(net.net, 0), 6) AS benchmark_pct
FROM cal c CROSS JOIN net CROSS JOIN d0
LEFT JOIN (SELECT gr.date, sum({value_expr}) AS book
           FROM gr JOIN pos USING (ticker) GROUP BY gr.date) b ON b.date = c.date""", MATRIX)


CURVE_DIGITS = {"portfolio": 4, "benchmark": 4, "*": 6}


@register("j01_portfolio_vs_benchmark", _curve_sql("gr.g * pos.inv"), CURVE_DIGITS)
def j01(t):
    """Long/short book from forecasts vs the index, dollar and percent curves."""
    return pf.portfolio_curve(t.forecasts, t.prices, t.index_prices)


CLAMP = ("CASE WHEN gr.g * pos.inv >= 0 THEN least(gr.g * pos.inv, pos.inv * (1 + pos.chg)) "
         "ELSE greatest(gr.g * pos.inv, pos.inv * (1 + pos.chg)) END")


@register("j02_portfolio_sell_targets", _curve_sql(CLAMP), CURVE_DIGITS)
def j02(t):
    """j01 with per-day sell-target clamping (the reference's exit mode)."""
    return pf.portfolio_curve_exit(t.forecasts, t.prices, t.index_prices, "clamp")


HIT = ("CASE WHEN v >= 0 THEN v > tgt ELSE v < tgt END")
EXIT_ONCE = with_views(["prices", "index_prices", "forecasts"], """
SELECT c.date,
       round(CASE WHEN c.date = d0.d0 THEN 0.0 ELSE coalesce(b.book, 0.0) - net.net END, 4) AS portfolio,
       round(CASE WHEN c.date = d0.d0 THEN 0.0 ELSE net.net * (c.idx / d0.idx0 - 1) END, 4) AS benchmark,
       round(CASE WHEN c.date = d0.d0 THEN 0.0 ELSE coalesce(b.book, 0.0) - net.net END / nullif(net.net, 0), 6) AS portfolio_pct,
       round(CASE WHEN c.date = d0.d0 THEN 0.0 ELSE net.net * (c.idx / d0.idx0 - 1) END / nullif(net.net, 0), 6) AS benchmark_pct
FROM cal c CROSS JOIN net CROSS JOIN d0
LEFT JOIN (SELECT date, sum(CASE WHEN frozen THEN tgt ELSE v END) AS book FROM (
              SELECT date, ticker, v, tgt,
                     bool_or(CASE WHEN v >= 0 THEN v > tgt ELSE v < tgt END)
                       OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                     OR (CASE WHEN inv >= 0 THEN inv > tgt ELSE inv < tgt END) AS frozen
              FROM (SELECT gr.date, gr.ticker, gr.g * pos.inv AS v, pos.inv, pos.inv * (1 + pos.chg) AS tgt
                    FROM gr JOIN pos USING (ticker)))
           GROUP BY date) b ON b.date = c.date""", MATRIX)


@register("j02_portfolio_exit_once", EXIT_ONCE, CURVE_DIGITS)
def j02_exit_once(t):
    """j01 where a position is sold at its target the first day it is reached, then held flat."""
    return pf.portfolio_curve_exit(t.forecasts, t.prices, t.index_prices, "exit_once")


@register("b17_position_sizing", with_views(["prices", "forecasts"], f"""
SELECT ticker, round(chg, 6) AS forecast_change, inv AS investment,
       round(inv * (1 + chg), 6) AS sell_price
FROM ({POS})"""))
def b17(t):
    """Long / short / flat sizing from the forecast change (b17, b19 ratio)."""
    return pf.positions(t.forecasts).select("ticker", "forecast_change", "investment", "sell_price")


@register("b18_sell_clamp", with_views(["prices", "forecasts"], f"""
SELECT ticker, date, round(CASE WHEN v >= 0 THEN least(v, tgt) ELSE greatest(v, tgt) END, 6) AS value
FROM (SELECT p.ticker, p.date, pos.inv * p.close / pos.market_cap AS v, pos.inv * (1 + pos.chg) AS tgt
      FROM prices p JOIN ({POS}) pos USING (ticker))"""))
def b18(t):
    """Clamp every raw position value (size x close / first close) at its sell target."""
    pos = pf.positions(t.forecasts)
    j = t.prices.join(pos, "ticker")
    return j.select("ticker", "date", pf.sell_clamp(pf.raw_value("investment", "close", "market_cap"), F.col("sell_price")).alias("value"))


@register("b19_ratio_columns", with_views(["prices", "forecasts"], """
SELECT ticker, round(market_cap_forecast / nullif(market_cap, 0) - 1, 6) AS forecast_change,
       round(market_cap_forecast / nullif(market_cap, 0), 6) AS price_ratio
FROM forecasts"""))
def b19(t):
    """Ratio columns with NULL on a zero denominator."""
    from ..functions.nulls import safe_div
    f = t.forecasts
    r = safe_div(F.col("market_cap_forecast"), F.col("market_cap"))
    return f.select("ticker", (r - 1).alias("forecast_change"), r.alias("price_ratio"))


@register("b20_ticker_suffix", """
SELECT c_custkey AS code, concat(c_name, '.AX') AS ticker FROM customer""")
def b20(t):
    """Exchange suffix appended to every company code."""
    return t.companies.select("code", F.concat(F.col("company"), F.lit(".AX")).alias("ticker"))


@register("d05_position_values", with_views(["prices", "forecasts"], f"""
SELECT ticker, date, round(g, 6) AS growth, round(inv * g, 6) AS value FROM (
  SELECT p.ticker, p.date, pos.inv,
         coalesce(last_value(p.close IGNORE NULLS) OVER w / first_value(p.close IGNORE NULLS) OVER w, 1.0) AS g
  FROM prices p JOIN ({POS}) pos USING (ticker)
  WHERE pos.inv <> 0
  WINDOW w AS (PARTITION BY p.ticker ORDER BY p.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""))
def d05(t):
    """Price growth x position size per ticker and quote date."""
    return pf.position_values(t.forecasts, t.prices)


@register("e05_book_value", with_views(["prices", "index_prices", "forecasts"], """
SELECT c.date, round(coalesce(b.gross, 0.0), 4) AS gross_value,
       round(coalesce(b.gross, 0.0) - net.net, 4) AS book_value
FROM cal c CROSS JOIN net
LEFT JOIN (SELECT date, sum(gr.g * pos.inv) AS gross FROM gr JOIN pos USING (ticker) GROUP BY date) b
  ON b.date = c.date""", MATRIX), {"*": 4})
def e05(t):
    """Σ padded position values per date, and that minus the net amount invested."""
    return pf.book_value(t.forecasts, t.prices, t.index_prices)


@register("f16_rebase_index", with_views(["prices", "index_prices"], """
SELECT date, round(CASE WHEN date = min(date) OVER () THEN 0.0
                        ELSE close / first_value(close) OVER (ORDER BY date) - 1 END, 6) AS index_return
FROM index_prices"""))
def f16(t):
    """Index cumulative return with the first row forced to 0 (per-date rows only)."""
    from pyspark.sql import Window
    w = Window.orderBy("date")
    r = t.index_prices.withColumn("index_return", F.col("close") / F.first("close").over(w) - 1)
    return ts.rebase_first(r, None, "date", "index_return", 0.0).select("date", "index_return")


@register("f18_benchmark_scaled", with_views(["prices", "index_prices", "forecasts"], """
SELECT c.date, round(CASE WHEN c.date = d0.d0 THEN 0.0 ELSE net.net * (c.idx / d0.idx0 - 1) END, 4) AS benchmark
FROM cal c CROSS JOIN net CROSS JOIN d0""", MATRIX), {"*": 4})
def f18(t):
    """Benchmark growth scaled to the net amount invested."""
    return pf.portfolio_curve(t.forecasts, t.prices, t.index_prices).select("date", "benchmark")


@register("a07_price_window", with_views(["prices"], """
SELECT p.ticker, p.date, p.close FROM prices p
WHERE p.date >= DATE '2024-01-05' AND p.date < DATE '2024-01-25'
  AND p.ticker IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""))
def a07(t):
    """Closes for a ticker list within [start, end) — filter + semi join + projection."""
    tickers = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("ticker"))
    return readers.price_window(t.prices_between("2024-01-05", "2024-01-25"), tickers, "2024-01-05", "2024-01-25")
