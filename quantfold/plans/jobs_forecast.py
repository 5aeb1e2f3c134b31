"""Registered forecasting jobs: i11–i15, e06–e08, g05, c05, c06."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..operators import panel as P
from ..session import cut_lineage
from .jobs_panel import MACRO_CTES, macro_sql, macro_wide
from .jobs_timeseries import REGION_COLS
from .registry import register
from .sqlviews import with_views

SERIES = [c for _, c in REGION_COLS]
LAGS = [f"{s}_lag2" for s in SERIES]
NCOLS = 1 + len(SERIES) + 1  # target, every series' lag 2, the dummy
N_TEST = 4


def design(t):
    """The design matrix is calendar-sized (targets × quarters) and feeds every backtest
    branch, so it is materialised once in the checkpoint folder instead of re-deriving
    it from the order table in each branch."""
    return cut_lineage(FC.design_matrix(macro_wide(t), SERIES, "crisis_dummy", extend=2, lag=2, skip=3))


def grid(t, d=None):
    d = design(t) if d is None else d
    return FC.parameter_grid(d.select("target").distinct(), NCOLS)


DESIGN_CTES = MACRO_CTES + [
    ("mw", macro_sql()),
    ("bnd", "SELECT min(date) AS lo, max(date) AS hi FROM mw"),
    ("sp", "SELECT last_day(lo + to_months(CAST(3 * i AS INTEGER))) AS date FROM bnd, range(0, date_diff('month', lo, hi) // 3 + 3) r(i)"),
    ("xw", f"""SELECT sp.date, {', '.join(SERIES)}, coalesce(mw.crisis_dummy, 0) AS crisis_dummy,
                      {', '.join(f'lag({s}, 2) OVER (ORDER BY sp.date) AS {s}_lag2' for s in SERIES)},
                      row_number() OVER (ORDER BY sp.date) AS rn
               FROM sp LEFT JOIN mw USING (date)"""),
    ("lng", "\nUNION ALL ".join(
        f"SELECT '{s}' AS target, date, {s} AS y, {s}_lag2 AS own_lag, crisis_dummy, {', '.join(LAGS)} FROM xw WHERE rn > 3"
        for s in SERIES)),
    ("dsg", "SELECT *, row_number() OVER (PARTITION BY target ORDER BY date) AS r FROM lng"),
    ("grd", f"""SELECT target, CAST(ceil(round({NCOLS} + i * ({50 - NCOLS} / 9), 9)) AS INTEGER) AS prior_length, j / 9 AS rho
               FROM (SELECT DISTINCT target FROM dsg), range(0, 10) a(i), range(0, 10) b(j)"""),
    ("lastk", "SELECT target, max(r) AS last_r FROM dsg WHERE y IS NOT NULL GROUP BY target"),
    ("gpo", f"SELECT g.target, prior_length, rho, last_r - k AS r_t FROM grd g JOIN lastk USING (target), range(0, {N_TEST}) o(k)"),
    ("ctr", "SELECT target, avg(own_lag) AS mx, avg(y) AS my FROM dsg WHERE y IS NOT NULL AND own_lag IS NOT NULL GROUP BY target"),
    ("trn", """SELECT g.target, g.prior_length, g.rho, g.r_t, d.y - my AS y, d.own_lag - mx AS x, pow(g.rho, g.r_t - 1 - d.r) AS w
               FROM gpo g JOIN ctr USING (target) JOIN dsg d ON d.target = g.target AND d.r BETWEEN g.r_t - g.prior_length AND g.r_t - 1
               WHERE d.y IS NOT NULL AND d.own_lag IS NOT NULL"""),
    ("sums", """SELECT target, prior_length, rho, r_t, sum(w) AS sw, sum(w * x) AS swx, sum(w * y) AS swy,
                       sum(w * x * x) AS swxx, sum(w * x * y) AS swxy FROM trn GROUP BY ALL"""),
    ("coef", """SELECT *, (sw * swxy - swx * swy) / nullif(sw * swxx - swx * swx, 0) AS slope FROM sums"""),
    ("preds", """SELECT c.target, c.prior_length, c.rho, d.date, d.y AS actual,
                        my + (c.swy - c.slope * c.swx) / nullif(c.sw, 0) + c.slope * (d.own_lag - mx) AS pred
                 FROM coef c JOIN ctr USING (target) JOIN dsg d ON d.target = c.target AND d.r = c.r_t WHERE d.y IS NOT NULL"""),
    ("mets", """SELECT target, prior_length, rho, avg(abs(pred - actual)) AS mae, sqrt(avg((pred - actual) * (pred - actual))) AS rmse
                FROM preds GROUP BY ALL"""),
    ("best", """SELECT target, arg_min(prior_length, (round(rmse, 4), prior_length, rho)) AS prior_length,
                       arg_min(rho, (round(rmse, 4), prior_length, rho)) AS rho, arg_min(rmse, (round(rmse, 4), prior_length, rho)) AS rmse,
                       arg_min(mae, (round(rmse, 4), prior_length, rho)) AS mae
                FROM mets WHERE rmse IS NOT NULL GROUP BY target"""),
    ("fut", """SELECT d.* FROM dsg d JOIN lastk USING (target) WHERE d.r > lastk.last_r"""),
    ("ftr", """SELECT b.target, f0.r_t, d.y - my AS y, d.own_lag - mx AS x, pow(b.rho, f0.r_t - 1 - d.r) AS w
               FROM best b JOIN ctr USING (target) JOIN (SELECT target, min(r) AS r_t FROM fut GROUP BY target) f0 USING (target)
               JOIN dsg d ON d.target = b.target AND d.r BETWEEN f0.r_t - b.prior_length AND f0.r_t - 1
               WHERE d.y IS NOT NULL AND d.own_lag IS NOT NULL"""),
    ("fco", """SELECT target, (sw * swxy - swx * swy) / nullif(sw * swxx - swx * swx, 0) AS slope, sw, swx, swy FROM (
                 SELECT target, sum(w) AS sw, sum(w * x) AS swx, sum(w * y) AS swy, sum(w * x * x) AS swxx,
                        sum(w * x * y) AS swxy FROM ftr GROUP BY target)"""),
    ("fc", """SELECT f.target, f.date, my + (c.swy - c.slope * c.swx) / nullif(c.sw, 0) + c.slope * (f.own_lag - mx) AS forecast
              FROM fut f JOIN ctr USING (target) JOIN fco c USING (target)"""),
    ("band", """SELECT fc.target, fc.date, fc.forecast, fc.forecast - sd.sd AS lower, fc.forecast + sd.sd AS upper
                FROM fc JOIN (SELECT target, stddev_samp(y) AS sd FROM dsg WHERE y IS NOT NULL GROUP BY target) sd USING (target)"""),
]


def sql(body: str) -> str:
    return with_views(["macro_obs"], body, DESIGN_CTES)


def r6(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def r2(cols):
    return ", ".join(f"round({c}, 2) AS {c}" for c in cols)


MONEY = {"*": 2, "rho": 6}


@register("i11_design_matrix", sql(f"SELECT target, date, {r6(['y', 'own_lag'] + LAGS)}, crisis_dummy FROM dsg"))
def i11(t):
    """Per target: y, every series' lag-2 (own lag too), the dummy, on a spine extended 2 quarters."""
    return design(t).select("target", "date", "y", "own_lag", *LAGS, "crisis_dummy")


@register("i12_parameter_grid", sql("SELECT target, prior_length, round(rho, 6) AS rho FROM grd"))
def i12(t):
    """(target × prior_length × rho) grid: 10 × 10 points per target, generated per target row."""
    return grid(t)


# backtest values are money-sized (1e5..1e6): 3 decimals are 8 to 9 digits
@register("i15_backtest_predictions", sql("SELECT target, prior_length, round(rho, 6) AS rho, date, "
                                          "round(actual, 3) AS actual, round(pred, 3) AS pred FROM preds"),
          digits={"actual": 3, "pred": 3, "*": 6})
def i15(t):
    """1-step-ahead predictions of the discount-weighted one-regressor model at each origin and grid point."""
    d = design(t)
    return FC.backtest_simple(d, grid(t, d), "own_lag", N_TEST)


def metrics(t):
    d = design(t)
    return FC.error_metrics(FC.backtest_simple(d, grid(t, d), "own_lag", N_TEST), ["target", "prior_length", "rho"])


@register("e06_backtest_errors", sql("SELECT target, prior_length, round(rho, 6) AS rho, round(mae, 3) AS mae, "
                                     "round(rmse, 3) AS rmse FROM mets"), digits={"mae": 3, "rmse": 3, "*": 6})
def e06(t):
    """MAE and RMSE per (target, grid point)."""
    return metrics(t)


@register("g05_best_params", sql(f"SELECT target, prior_length, round(rho, 6) AS rho, {r2(['rmse', 'mae'])} FROM best"), MONEY)
def g05(t):
    """Grid point with the smallest RMSE per target (ties: smaller parameters)."""
    return FC.best_params(metrics(t))


@register("e08_median_error", sql("""
SELECT target, round(quantile_cont(abs(pred - actual), 0.5), 2) AS median_abs_error FROM preds GROUP BY target"""), MONEY)
def e08(t):
    """Exact median absolute backtest error per target."""
    d = design(t)
    return FC.error_median(FC.backtest_simple(d, grid(t, d), "own_lag", N_TEST), ["target"])


def forecasts(t):
    d = design(t)
    best = FC.best_params(FC.error_metrics(FC.backtest_simple(d, grid(t, d), "own_lag", N_TEST),
                                           ["target", "prior_length", "rho"]))
    return d, FC.forecast_simple(d, best, "own_lag")


@register("i14_forecast", sql("SELECT target, date, round(forecast, 2) AS forecast FROM fc"), MONEY)
def i14(t):
    """Refit with the best grid point and forecast the two future quarters."""
    return forecasts(t)[1]


@register("e07_forecast_band", sql(f"SELECT target, date, {r2(['forecast', 'lower', 'upper'])} FROM band"), MONEY)
def e07(t):
    """Forecast ± the sample std of the target's actuals."""
    d, f = forecasts(t)
    return FC.forecast_band(f, d)


@register("c05_actuals_and_forecasts", sql("""
SELECT target, date, round(y, 2) AS value, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM dsg WHERE y IS NOT NULL
UNION ALL SELECT target, date, round(forecast, 2), round(lower, 2), round(upper, 2) FROM band"""), MONEY)
def c05(t):
    """Actual rows with the forecast rows appended (band columns NULL on actuals)."""
    d, f = forecasts(t)
    act = d.where(F.col("y").isNotNull()).select("target", "date", F.col("y").alias("value"))
    fc = FC.forecast_band(f, d).select("target", "date", F.col("forecast").alias("value"), "lower", "upper")
    return P.union_files([act, fc])


@register("c06_forecast_transpose", sql(
    "SELECT date, " + ", ".join(f"round(max(forecast) FILTER (WHERE target = '{s}'), 2) AS {s}" for s in SERIES)
    + " FROM fc GROUP BY date"), MONEY)
def c06(t):
    """Forecasts transposed: one row per future date, one column per series."""
    return P.pivot_items(forecasts(t)[1], ["date"], "target", "forecast", SERIES)


@register("i13_backtest_multi")
def i13(t):
    """Weighted least squares on every series' lag-2 and the dummy: MAE/RMSE per grid point (numpy solve)."""
    d = design(t)
    p = FC.backtest_multi(d, grid(t, d), [*LAGS, "crisis_dummy"], N_TEST)
    return FC.error_metrics(p, ["target", "prior_length", "rho"])


@register("i14_forecast_multi", digits={"*": 2, "rho": 6})
def i14_multi(t):
    """The multi-regressor model to its end: best grid point by RMSE, refit, two quarters ahead, appended to the actuals."""
    d = design(t)
    xcols = [*LAGS, "crisis_dummy"]
    best = FC.best_params(FC.error_metrics(FC.backtest_multi(d, grid(t, d), xcols, N_TEST), ["target", "prior_length", "rho"]))
    best = cut_lineage(best)  # one row a target, read for the refit and the result
    act = d.where(F.col("y").isNotNull()).select("target", "date", F.col("y").alias("value"))
    ahead = FC.forecast_multi(d, best, xcols).select("target", "date", F.col("forecast").alias("value"))
    out = P.union_files([act.withColumn("is_forecast", F.lit(False)), ahead.withColumn("is_forecast", F.lit(True))])
    return out.join(best.select("target", "prior_length", "rho", "rmse"), "target", "left")
