"""Fixtures for filters, quartiles, correlation, sizing and clamps (FIXTURES §2 rows 5-7, 10-12, 21, 22)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantfold.operators import panel as P
from quantfold.operators import portfolio as pf
from conftest import rows


def test_keep_not_equal_keeps_null(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1.0,)], "x double")
    assert sorted(rows(P.keep_not_equal(df, "x", 0)), key=str) == [(1.0,), (None,)]


def test_quartiles_right_closed(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "x double")
    e = rows(P.quartile_edges(df, "x"))[0]
    assert e == pytest.approx((2.75, 4.5, 6.25))
    lab = sorted(rows(P.quartile_label(df, "x", "q"), "x", "q"))
    assert [q for _, q in lab] == ["Q1", "Q1", "Q2", "Q2", "Q3", "Q3", "Q4", "Q4"]
    d = rows(P.quartile_dummies(df, "x").orderBy("x"), "quartile_q2", "quartile_q3", "quartile_q4")
    assert d[0] == (0, 0, 0) and d[2] == (1, 0, 0) and d[7] == (0, 0, 1)


def test_correlation_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 2.1), (3.0, 5.0, 2.9)], "a double, b double, c double")
    out = {(a, b): r for a, b, r in rows(P.correlation_pairs(df, ["a", "b", "c"]))}
    assert out[("a", "b")] is None
    import numpy as np
    assert out[("a", "c")] == pytest.approx(np.corrcoef([1.0, 2.0, 3.0], [1.0, 2.1, 2.9])[0, 1], abs=1e-12)


def test_position_size(spark):
    df = spark.createDataFrame([(0.05,), (0.049,), (-0.05,), (None,)], "c double")
    assert [r[0] for r in rows(df.select(pf.position_size("c")))] == [1000.0, 0.0, -1000.0, 0.0]


def test_sell_clamp(spark):
    df = spark.createDataFrame([(1200.0, 1100.0), (-900.0, -950.0), (-1000.0, -950.0), (0.0, 0.0)], "v double, t double")
    assert [r[0] for r in rows(df.select(pf.sell_clamp("v", "t")))] == [1100.0, -900.0, -950.0, 0.0]


def _book(spark, inv_pairs):
    fc = spark.createDataFrame([(t, 10.0, 10.0 * (1 + c)) for t, c in inv_pairs],
                               "ticker int, market_cap double, market_cap_forecast double")
    pr = spark.createDataFrame([(t, dt.date(2024, 1, d), 10.0 + d * (t + 1)) for t, _ in inv_pairs for d in range(1, 6)],
                               "ticker int, date date, close double")
    idx = pr.groupBy("date").agg(F.avg("close").alias("close"))
    return fc, pr, idx


def test_net_flat_book_has_null_percent(spark):
    fc, pr, idx = _book(spark, [(0, 0.2), (1, -0.2)])
    out = rows(pf.portfolio_curve(fc, pr, idx).orderBy("date"), "portfolio", "portfolio_pct", "benchmark_pct")
    assert out[0][0] == 0.0
    assert all(p is not None for p, _, _ in out) and all(pp is None and bp is None for _, pp, bp in out)


def test_curve_matches_dense_matrix(spark):
    fc, pr, idx = _book(spark, [(0, 0.2), (1, -0.3), (2, 0.0), (3, 0.1)])
    pr = pr.where(~((F.col("ticker") == 3) & (F.col("date") < dt.date(2024, 1, 3))))  # late listing
    curve = {d: v for d, v in rows(pf.portfolio_curve(fc, pr, idx), "date", "portfolio")}
    inv = {0: 1000.0, 1: -1000.0, 2: 0.0, 3: 1000.0}
    px = {(t, d): c for t, d, c in rows(pr, "ticker", "date", "close")}
    dates = sorted(curve)
    for i, d in enumerate(dates):
        want = 0.0
        if i > 0:
            for t, size in inv.items():
                seen = [px[(t, x)] for x in dates[: i + 1] if (t, x) in px]
                g = seen[-1] / seen[0] if seen else 1.0
                want += size * g
            want -= sum(inv.values())
        assert curve[d] == pytest.approx(want, abs=1e-9)


def test_drop_every_second(spark):
    df = spark.createDataFrame([("ALL", i) for i in range(1, 6)] + [("X", 1)], "company string, i int")
    out = P.drop_every_nth(df, "company", "i", 2, where=F.col("company") == "ALL")
    assert sorted(rows(out)) == [("ALL", 2), ("ALL", 4), ("X", 1)]


def test_every_20th_and_last(spark):
    df = spark.createDataFrame([(i,) for i in range(45)], "i int")
    assert sorted(r[0] for r in rows(P.every_kth_and_last(df, "i", 20))) == [20, 40, 44]


def test_title_case(spark):
    df = spark.createDataFrame([("ebit/trading rev.",), ("CL - total assets",)], "s string")
    assert [r[0] for r in rows(df.select(P.title_case("s")))] == ["Ebit/Trading Rev.", "Cl - Total Assets"]


@pytest.mark.parametrize("mode", ["clamp", "exit_once"])
def test_exit_modes_match_dense_matrix(spark, mode):
    import random
    rnd = random.Random(11)
    tick = [(0, 0.2), (1, -0.3), (2, 0.06), (3, -0.08), (4, 0.0)]
    fc = spark.createDataFrame([(t, 10.0, 10.0 * (1 + c)) for t, c in tick],
                               "ticker int, market_cap double, market_cap_forecast double")
    data = [(t, dt.date(2024, 1, d), round(10.0 * (1 + rnd.uniform(-0.4, 0.4)), 2))
            for t, _ in tick for d in range(1, 21) if rnd.random() > 0.25 and not (t == 3 and d < 6)]
    pr = spark.createDataFrame(data, "ticker int, date date, close double")
    idx = pr.groupBy("date").agg(F.avg("close").alias("close"))
    got = dict(rows(pf.portfolio_curve_exit(fc, pr, idx, mode), "date", "portfolio"))
    px = {(t, d): c for t, d, c in data}
    dates = sorted(got)
    size = {t: (1000.0 if c >= 0.05 else -1000.0 if c <= -0.05 else 0.0) for t, c in tick}
    tgt = {t: size[t] * (1 + c) for t, c in tick}

    def clamp(v, t):
        return min(v, t) if v >= 0 else max(v, t)

    def hit(v, t):
        return v > t if v >= 0 else v < t

    frozen = {t: False for t, _ in tick}
    for i, d in enumerate(dates):
        total = 0.0
        for t, _ in tick:
            seen = [px[(t, x)] for x in dates[: i + 1] if (t, x) in px]
            v = size[t] * (seen[-1] / seen[0] if seen else 1.0)
            if mode == "clamp":
                v = clamp(v, tgt[t])
            else:
                frozen[t] = frozen[t] or hit(v, tgt[t])
                v = tgt[t] if frozen[t] else v
            total += v
        want = 0.0 if i == 0 else total - sum(size.values())
        assert got[d] == pytest.approx(want, abs=1e-9), (mode, d)


def test_mostly_zero_item_disappears_from_wide_panel(spark):
    from quantfold.plans import compose as C
    rows_ = []
    for p, d in enumerate([dt.date(2020, 6, 30), dt.date(2020, 12, 31), dt.date(2021, 6, 30)]):
        rows_ += [(1, "Profit Loss", "Revenue", d, 10.0 + p), (1, "Profit Loss", "Tax", d, 0.0 if p < 2 else 1.0),
                  (1, "Balance Sheet", "Market Cap.", d, 100.0 + p), (1, "Balance Sheet", "Units", d, 5.0),
                  (1, "Cash Flow", "Discounts", d, 2.0), (1, "Cash Flow", "Returns", d, 3.0),
                  (1, "Ratio Analysis", "Share Price", d, 4.0), (1, "Ratio Analysis", "Return Rate", d, 0.1)]
    st = spark.createDataFrame(rows_, "company bigint, sheet string, item string, period date, value double")
    wide = C.wide_statements(st)
    assert "tax" not in wide.columns and "revenue" in wide.columns
    got = {r["date"]: r["cash_adjustments"] for r in wide.collect()}
    assert set(got.values()) == {2.0}  # Discounts wins over Returns (same sheet, source-item order)
    assert wide.dropna().count() == 3


def test_nan_forecast_opens_no_position(spark):
    f = spark.createDataFrame([("a", float("nan"), 1.0), ("b", 1.0, float("nan")), ("c", 2.0, 1.0)],
                              "ticker string, market_cap_forecast double, market_cap double")
    got = {r["ticker"]: (r["investment"], r["sell_price"]) for r in pf.positions(f).collect()}
    assert got["a"] == (0.0, None) and got["b"] == (0.0, None) and got["c"] == (1000.0, 2000.0)


def test_sell_clamp_of_a_first_close_of_zero(spark, tmp_path):
    """b18: a ticker whose first close is 0 has no position and the SQL's floating quotient, 0 / 0; the others are as ever."""
    import math

    from __spark_entry__ import queries
    day = lambda d: dt.datetime(2024, 1, d)
    spark.createDataFrame([(1, day(1), 7, 0.0), (2, day(2), 7, 5.0), (3, day(1), 8, 10.0), (4, day(2), 8, 30.0)],
                          "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(t, d.day): v for t, d, v in rows(queries()["b18_sell_clamp"](spark, str(tmp_path)))}
    assert math.isnan(got[7, 1]) and math.isnan(got[7, 2])
    assert got[8, 1] == 1000.0 and got[8, 2] == 2000.0
