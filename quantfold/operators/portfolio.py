"""Long/short portfolio valuation against a benchmark index (b17–b19, j01, j02).

Plan shape (no ticker × calendar matrix is ever built):

1. positions: one row per ticker from the forecast table (b17/b19).
2. growth: per (ticker, date) price index = forward-filled close / first close
   (f04), one hash shuffle on ticker + a sort.
3. each ticker contributes only *changes* of its position value on the days
   it trades; ``sum`` per date is a partial/final aggregate, so a ticker with
   a third of all rows still shrinks to one partial sum per date per task.
4. the curve is a running sum over the per-date rows (one row per date) plus
   a scalar baseline; the benchmark is the index's own growth times the net
   amount invested, a scalar subquery rather than a join.

Dollar and percent curves are both returned; percent is NULL when the book
is net flat (``try_divide``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions._util import as_col
from ..functions.nulls import nan_to_null, safe_div
from .timeseries import cum_index, rebase_first


def position_size(change, threshold: float = 0.05, size: float = 1000.0) -> Column:
    """b17: +size when change >= threshold, -size when <= -threshold, else 0."""
    c = as_col(change)
    return (F.when(c >= F.lit(threshold), F.lit(float(size)))
             .when(c <= F.lit(-threshold), F.lit(-float(size)))
             .otherwise(F.lit(0.0)))


def raw_value(size, close, first) -> Column:
    """size x close / first close; a first close of 0 gives the floating quotient (NaN for a size of 0), not an error."""
    held, first = as_col(size) * as_col(close), as_col(first)
    return F.when(first == 0, held * F.lit(float("inf"))).otherwise(safe_div(held, first))


def sell_clamp(value, target) -> Column:
    """b18: non-negative value capped at the target; negative value floored at it."""
    v, t = as_col(value), as_col(target)
    return F.when(v >= 0, F.least(v, t)).otherwise(F.greatest(v, t))


def sell_hit(value, target) -> Column:
    """True when ``sell_clamp`` would change the value."""
    v, t = as_col(value), as_col(target)
    return F.when(v >= 0, v > t).otherwise(v < t)


def positions(forecasts: DataFrame, threshold: float = 0.05, size: float = 1000.0) -> DataFrame:
    """b17 + b19: forecast change, position size and sell target per ticker."""
    # a NaN would order above every threshold and open a long position
    chg = safe_div(nan_to_null("market_cap_forecast"), nan_to_null("market_cap")) - F.lit(1.0)
    return (forecasts
            .select("ticker", "market_cap", "market_cap_forecast", chg.alias("forecast_change"))
            .withColumn("investment", position_size("forecast_change", threshold, size))
            .withColumn("sell_price", F.col("investment") * (F.lit(1.0) + F.col("forecast_change"))))


def _book(pos: DataFrame, prices: DataFrame, index_prices: DataFrame, exit: str | None) -> DataFrame:
    """(date, idx, book, net): Σ position values − net invested, on the index calendar."""
    active = pos.where(F.col("investment") != 0)
    g = cum_index(prices.join(active.select("ticker", "investment", "sell_price"), "ticker"),
                  "ticker", "date", "close", "growth")
    raw = F.col("investment") * F.col("growth")
    inv, tgt = F.col("investment"), F.col("sell_price")
    if exit is None:
        value, before = raw, inv
    elif exit == "clamp":
        value, before = sell_clamp(raw, tgt), sell_clamp(inv, tgt)
    elif exit == "exit_once":
        w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hit_before = F.coalesce(sell_hit(inv, tgt), F.lit(False))
        frozen = hit_before | F.max(F.coalesce(sell_hit(raw, tgt), F.lit(False))).over(w)
        value, before = F.when(frozen, tgt).otherwise(raw), F.when(hit_before, tgt).otherwise(inv)
    else:
        raise ValueError(f"unknown exit mode {exit!r}")
    g = g.withColumn("__v", value).withColumn("__v0", before)
    step = F.col("__v") - F.coalesce(F.lag("__v").over(Window.partitionBy("ticker").orderBy("date")), F.col("__v0"))
    per_date = g.withColumn("__d", step).groupBy("date").agg(F.sum("__d").alias("__delta"))
    # value each ticker holds before its first quote, minus the amount invested
    baseline = active.select(F.sum(before - inv).alias("b")).scalar() if exit else F.lit(0.0)
    net = pos.select(F.sum("investment").alias("net")).scalar()
    running = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (index_prices.select("date", F.col("close").alias("__idx"))
            .join(per_date, "date", "left")
            .withColumn("book", F.coalesce(baseline, F.lit(0.0)) +
                        F.sum(F.coalesce("__delta", F.lit(0.0))).over(running))
            .withColumn("net", F.coalesce(net, F.lit(0.0))))


def _value_curve(pos: DataFrame, prices: DataFrame, index_prices: DataFrame, exit: str | None) -> DataFrame:
    curve = (_book(pos, prices, index_prices, exit)
             .withColumn("portfolio", F.col("book"))
             .withColumn("benchmark", F.col("net") * (safe_div(F.col("__idx"), F.first("__idx").over(Window.orderBy("date"))) - F.lit(1.0))))
    curve = rebase_first(curve, None, "date", "portfolio", 0.0)
    curve = rebase_first(curve, None, "date", "benchmark", 0.0)
    return curve.select(
        "date", "portfolio", "benchmark",
        safe_div(F.col("portfolio"), F.col("net")).alias("portfolio_pct"),
        safe_div(F.col("benchmark"), F.col("net")).alias("benchmark_pct"))


def book_value(forecasts: DataFrame, prices: DataFrame, index_prices: DataFrame,
               threshold: float = 0.05, size: float = 1000.0) -> DataFrame:
    """e05: per date, Σ over tickers of the padded position value, and that minus net invested."""
    b = _book(positions(forecasts, threshold, size), prices, index_prices, None)
    return b.select("date", (F.col("book") + F.col("net")).alias("gross_value"), F.col("book").alias("book_value"))


def portfolio_curve(forecasts: DataFrame, prices: DataFrame, index_prices: DataFrame,
                    threshold: float = 0.05, size: float = 1000.0) -> DataFrame:
    """j01: daily value of the long/short book and of the benchmark."""
    return _value_curve(positions(forecasts, threshold, size), prices, index_prices, None)


def portfolio_curve_exit(forecasts: DataFrame, prices: DataFrame, index_prices: DataFrame,
                         mode: str = "clamp", threshold: float = 0.05, size: float = 1000.0) -> DataFrame:
    """j02: as j01 with sell targets; ``clamp`` (per day) or ``exit_once`` (frozen after the hit)."""
    return _value_curve(positions(forecasts, threshold, size), prices, index_prices, mode)


def position_values(forecasts: DataFrame, prices: DataFrame, threshold: float = 0.05,
                    size: float = 1000.0) -> DataFrame:
    """d05: per (ticker, date) position value = size × price growth (active tickers)."""
    pos = positions(forecasts, threshold, size).where(F.col("investment") != 0)
    g = cum_index(prices.join(pos.select("ticker", "investment"), "ticker"), "ticker", "date", "close", "growth")
    return g.select("ticker", "date", "growth", (F.col("investment") * F.col("growth")).alias("value"))
