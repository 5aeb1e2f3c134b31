"""Composed jobs: the quarterly macro panel (j04) and the model panel (j03).

Each is a lazy chain of library operators; Catalyst plans the whole chain
at once, so pruning and pushdown reach the scans of the raw tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_flag
from ..operators import panel as P
from ..operators import timeseries as ts
from ..session import reuse

# Fixed values of the statement clean-up (the reference works on the same
# kind of lists: synonym renames, sheet order, a hand-kept drop list).
ITEM_RENAMES = {"Units": "Quantity", "Discounts": "Cash Adjustments", "Returns": "Cash Adjustments"}
SHEET_ORDER = {"Profit Loss": 1, "Balance Sheet": 2, "Cash Flow": 3, "Ratio Analysis": 4}
PANEL_ITEMS = ["Revenue", "Tax", "Market Cap.", "Quantity", "Cash Adjustments", "Share Price", "Return Rate"]
PANEL_NAMES = ["revenue", "tax", "market_cap", "quantity", "cash_adjustments", "share_price", "return_rate"]


def sheet_rank(col: str = "sheet"):
    m = F.create_map(*[F.lit(x) for kv in SHEET_ORDER.items() for x in kv])
    return m[F.col(col)]


def renamed_statements(statements: DataFrame) -> DataFrame:
    """b01 + c03: synonym renames, then first-wins de-duplication."""
    st = statements.withColumn("src_item", F.col("item"))
    st = P.rename_items(st, "item", ITEM_RENAMES)
    return P.first_wins(st, ["company", "period", "item"], F.struct(sheet_rank(), F.col("src_item")))


def clean_statements(statements: DataFrame) -> DataFrame:
    """b01 + c03 + b23: synonym renames, first-wins de-duplication, mostly-zero items dropped."""
    return P.drop_mostly_zero(renamed_statements(statements), "item", "value", 0.5)


def wide_statements(statements: DataFrame) -> DataFrame:
    """c01/d01: cleaned long statements -> one row per (company, date).

    Items dropped as mostly zero (b23) disappear as columns, as a dropped
    column does; the dropped list is read once (at most the fixed item count).
    """
    # companies x items x periods: small, read for the dropped items and the pivot, so the raw lines are aggregated once
    st = reuse(renamed_statements(statements))
    dropped = {r[0] for r in P.zero_share_items(st, "item", "value", 0.5).select("item").collect()}
    keep = [(i, n) for i, n in zip(PANEL_ITEMS, PANEL_NAMES) if i not in dropped]
    st = st.where(~F.col("item").isin(list(dropped))) if dropped else st
    return P.pivot_items(st.withColumnRenamed("period", "date"), ["company", "date"], "item", "value",
                         [i for i, _ in keep], [n for _, n in keep])


def month_spine(monthly: DataFrame, key: str = "series", date_col: str = "date") -> DataFrame:
    """Every month between the global first and last month, for every key.

    Bounds come from one scalar subquery; rows are generated per key with
    ``sequence`` (keys × months is the output itself, not a join).
    """
    b = monthly.select(F.struct(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))).scalar()
    lo, hi = b["lo"], b["hi"]  # one scalar subquery for both bounds
    n = F.months_between(hi, lo).cast("int")
    return (monthly.select(key).distinct()
            .select(key, F.explode(F.sequence(F.lit(0), n)).alias("__i"))
            .select(key, F.last_day(F.add_months(lo, F.col("__i"))).alias(date_col)))


def quarterly_macro(macro_obs: DataFrame, series: Sequence[str], names: Sequence[str],
                    lead_series: str | None = "AMERICA", dummy=("1997-06-30", "1998-12-31"),
                    months=(3, 6, 9, 12)) -> DataFrame:
    """j04: a03→f07→d10→f01→f06→b07→d09→b13→b16.

    Long until the final pivot: resample to month ends (last observation),
    reindex every series on the global month spine, lead one series by one
    month, forward-fill within each series, keep quarter-end months, pivot
    over the supplied series list, drop incomplete dates, add the dummy.
    """
    # series × months: tiny, and read three times (spine bounds, spine keys, join) —
    # kept so the observation table is aggregated once
    m = reuse(ts.monthly_last(macro_obs, "series", "obs_date", "value", "obs_id"))
    s = month_spine(m).join(m, ["series", "date"], "left")
    if lead_series is not None:
        led = F.lead("value").over(ts.win("series", "date"))
        s = s.withColumn("value", F.when(F.col("series") == lead_series, led).otherwise(F.col("value")))
    s = ts.forward_fill(s, "series", "date", ["value"])
    s = s.where(F.month("date").isin(list(months)))
    wide = ts.align_series(s, "date", "series", "value", series, names)
    wide = P.drop_nulls(wide)
    return wide.withColumn("crisis_dummy", date_flag("date", *dummy))


def company_daily(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Daily value series per company (nation): Σ order value per day."""
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .groupBy(F.col("c_nationkey").cast("bigint").alias("company"), F.to_date("o_orderdate").alias("day"))
            .agg(F.sum("o_totalprice").alias("close")))


def model_panel(statements: DataFrame, macro_wide: DataFrame, daily: DataFrame,
                gfc=("1997-06-30", "1998-12-31")) -> DataFrame:
    """j03: statements + macro + daily series -> model-ready panel.

    c01→b01/c03/b23→b04→b13→f01→(b07,f10)→d02→b16→i03→f17→f02→(f03,f05)→d06→b13→f03.
    """
    wide = wide_statements(statements)
    wide = P.keep_not_equal(wide, "market_cap", 0)
    wide = P.drop_nulls(wide)
    wide = ts.lead_by(wide, "company", "date", "market_cap", 1, "market_cap_forecast")
    macro = macro_wide.where(F.month("date").isin(6, 12))
    macro = ts.shift_months_to_month_end(macro, "date", 6)
    # macro has one row per half-year: tiny and bounded by the calendar, so the
    # optimizer's size estimate (or AQE at run time) makes this a broadcast join
    df = wide.join(macro, "date")
    df = df.withColumn("gfc_recession", date_flag("date", *gfc))
    # companies × periods: small, and read several times below (quartile edges,
    # the as-of join's buckets and rows) — keep it
    df = reuse(df)
    df = P.quartile_dummies(df, "market_cap", "quartile_")
    df = ts.distance_from_max(df, "company", "date", "market_cap", "change_ath", lookahead=True)
    df = ts.lag_by(df, "company", "date", "market_cap", 1, "market_cap_lag")
    r = ts.pct_change(daily, "company", "day", "close", "ret")
    r = ts.expanding_std(r, "company", "day", "ret", "rolling_std").select("company", "day", "rolling_std")
    r = reuse(r)  # companies × days, read twice by the as-of join
    df = ts.asof_backward(df, r, "company", "date", "day", ["rolling_std"])
    df = P.drop_nulls(df, ["rolling_std"])
    return ts.pct_change(df, "company", "date", "market_cap", "market_cap_change")
