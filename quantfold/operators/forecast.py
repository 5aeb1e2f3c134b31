"""Per-series forecasting: design matrix, parameter grid, backtest, refit (i11–i15, e06–e08, g05).

The model is a discount-weighted linear regression: an observation ``age``
periods before the forecast origin has weight ``rho ** age`` and at most the
``prior_length`` most recent observations are used. Everything up to the
coefficient solve is Spark: the grid is generated per series with
``sequence`` (no cross join). Training rows are row indices exploded once per
(series, rho, origin) and joined on (series, row) — an equi join; hash
aggregates add them up per stretch between two window lengths and running
sums give every length. Columns are centred first. The one-regressor case has
a closed form (i15). With several regressors only the p×p solve runs in
numpy, vectorised over a whole Arrow batch of grid points (i13, i14).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import safe_div
from .quantiles import exact_quantiles


# ---- i11: design matrix --------------------------------------------------------------
def design_matrix(macro: DataFrame, series: Sequence[str], dummy: str, extend: int = 2, lag: int = 2,
                  skip: int = 3, step_months: int = 3) -> DataFrame:
    """i11/f13/d10/f02/f14: one row per (target, date) with y, every series' lag and the dummy.

    The wide macro panel is one row per quarter, so its lags are an
    unpartitioned window over a calendar-sized table; the per-target rows
    are an unpivot of it.
    """
    series = list(series)
    b = macro.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    n = (F.months_between("hi", "lo") / step_months).cast("int") + extend
    spine = b.select(F.explode(F.sequence(F.lit(0), n)).alias("i"), "lo") \
             .select(F.last_day(F.add_months("lo", F.col("i") * step_months)).alias("date"))
    w = Window.orderBy("date")
    x = spine.join(macro.select("date", *series, dummy), "date", "left")
    x = x.select("date", *series, F.coalesce(F.col(dummy), F.lit(0)).alias(dummy),
                 *[F.lag(s, lag).over(w).alias(f"{s}_lag{lag}") for s in series],
                 F.row_number().over(w).alias("__rn"))
    x = x.where(F.col("__rn") > skip).drop("__rn")
    long = x.unpivot(["date", dummy, *[f"{s}_lag{lag}" for s in series]], series, "target", "y")
    own = F.create_map(*[a for s in series for a in (F.lit(s), F.col(f"{s}_lag{lag}"))])[F.col("target")]
    return (long.withColumn("own_lag", own)
                .withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy("date"))))


# ---- i12: grid -----------------------------------------------------------------------------
def parameter_grid(targets: DataFrame, ncols: int, max_prior: int = 50, points: int = 10) -> DataFrame:
    """i12: per target, prior_length = ceil(linspace(ncols, max_prior, points)) × rho = linspace(0, 1, points)."""
    step = (max_prior - ncols) / (points - 1)
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    g = targets.select("target", i.alias("i")).select("target", "i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("j"))
    return g.select("target",
                    F.ceil(F.round(F.lit(float(ncols)) + F.col("i") * F.lit(step), 9)).cast("int").alias("prior_length"),
                    (F.col("j") / F.lit(points - 1)).alias("rho"))


def _last_known(design: DataFrame) -> DataFrame:
    return design.where(F.col("y").isNotNull()).groupBy("target").agg(F.max("r").alias("__last"))


def _grid_origins(design: DataFrame, grid: DataFrame, n_test: int) -> DataFrame:
    """Grid points × backtest origins: the last ``n_test`` row indices up to the last known y.

    One aggregate row per target joins the grid (many-to-one) and the
    origins are generated with ``sequence``; no pairing of two row sets.
    """
    g = grid.join(_last_known(design), "target").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_test - 1))).alias("__k"))
    return g.select("target", "prior_length", "rho", (F.col("__last") - F.col("__k")).alias("r_t"))


def _future(design: DataFrame) -> DataFrame:
    """Rows behind the last known y, whose regressors are known."""
    return design.join(_last_known(design), "target").where(F.col("r") > F.col("__last")).drop("__last")


def _complete(design: DataFrame, xcols: Sequence[str]) -> DataFrame:
    return design.where(F.col("y").isNotNull()).dropna(subset=list(xcols)) if xcols else design.where(F.col("y").isNotNull())


def _centred(design: DataFrame, xcols: Sequence[str], scaled: bool = False) -> DataFrame:
    """``design`` with ``c_y`` and every ``c_<x>`` less its target's mean (and over its deviation), and the mean of y.

    A regression with an intercept predicts the same; sums of squares of
    money-sized columns no longer cancel.
    """
    cols = ["y", *xcols]
    known = _complete(design, xcols).groupBy("target").agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in xcols])
    out = design.join(known, "target")
    width = lambda c: F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(F.lit(1.0)) if scaled and c != "y" else F.lit(1.0)
    return out.withColumns({f"c_{c}": (F.col(c) - F.col(f"m_{c}")) / width(c) for c in cols}).drop(*[f"s_{c}" for c in xcols])


def _discounted_sums(centred: DataFrame, points: DataFrame, xcols: Sequence[str], terms: dict) -> DataFrame:
    """Σ w·term over the training window of every point (target, prior_length, rho, r_t).

    The rows before an origin are read once per (target, rho, origin) and
    added up per *segment*, the stretch between two neighbouring window
    lengths; the sum for a length is the running sum of the segments up to it.
    All window lengths of a rho thus come from one pass, without differences
    of large sums. Windows without a training row have no result row.
    """
    lengths = points.groupBy("target").agg(F.sort_array(F.collect_set("prior_length")).alias("__lens"))
    # few lengths a target, so few numbers in the array
    origins = points.select("target", "rho", "r_t").distinct().join(lengths, "target")
    ages = origins.select("*", F.explode(F.sequence(F.lit(0), F.element_at("__lens", -1) - 1)).alias("__age")).withColumn(
        "r", F.col("r_t") - 1 - F.col("__age"))
    rows = ages.join(_complete(centred, xcols).select("target", "r", *{f"c_{c}" for c in ["y", *xcols]}), ["target", "r"])
    rows = (rows.withColumn("w", F.pow(F.col("rho"), F.col("__age").cast("double")))
            .withColumn("__seg", F.size(F.filter("__lens", lambda n: n <= F.col("__age")))))
    names = list(terms)
    keys = ["target", "rho", "r_t"]
    parts = rows.groupBy(*keys, "__seg").agg(F.count("*").alias("__rows"), *[F.sum(F.col("w") * terms[n]).alias(n) for n in names])
    spine = origins.select(*keys, F.posexplode("__lens").alias("__seg", "prior_length"))
    upto = Window.partitionBy(*keys).orderBy("__seg")
    run = spine.join(parts, [*keys, "__seg"], "left").select(
        *keys, "prior_length", *[F.sum(F.coalesce(F.col(n), F.lit(0.0))).over(upto).alias(n) for n in names],
        F.sum(F.coalesce("__rows", F.lit(0))).over(upto).alias("__rows"))
    wanted = points.select("target", "prior_length", "rho", "r_t").distinct()
    return run.where("__rows > 0").drop("__rows").join(wanted, ["target", "prior_length", "rho", "r_t"])


# ---- i15: closed form, one regressor ---------------------------------------------------
def _fit_simple(centred: DataFrame, points: DataFrame, xcol: str) -> DataFrame:
    """Slope and intercept (on centred columns) of every point."""
    x, y = F.col(f"c_{xcol}"), F.col("c_y")
    s = _discounted_sums(centred, points, [xcol], {"sw": F.lit(1.0), "swx": x, "swy": y, "swxx": x * x, "swxy": x * y})
    slope = safe_div(F.col("sw") * F.col("swxy") - F.col("swx") * F.col("swy"),
                     F.col("sw") * F.col("swxx") - F.col("swx") * F.col("swx"))
    s = s.withColumn("slope", slope)
    return s.withColumn("intercept", safe_div(F.col("swy") - F.col("slope") * F.col("swx"), F.col("sw")))


def backtest_simple(design: DataFrame, grid: DataFrame, xcol: str, n_test: int = 4) -> DataFrame:
    """i15: 1-step-ahead predictions at every origin and grid point, y ~ a + b·x weighted."""
    centred = _centred(design, [xcol])
    s = _fit_simple(centred, _grid_origins(design, grid, n_test), xcol)
    known = centred.where(F.col("y").isNotNull()).select("target", F.col("r").alias("r_t"), "date", F.col("y").alias("actual"),
                                                         F.col(f"c_{xcol}").alias("x_t"), "m_y")
    p = s.join(known, ["target", "r_t"])
    return p.select("target", "prior_length", "rho", "date", "actual",
                    (F.col("m_y") + F.col("intercept") + F.col("slope") * F.col("x_t")).alias("pred"))


# ---- e06 / g05 / e07 / e08 -------------------------------------------------------------------
def error_metrics(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """e06: MAE and RMSE per key."""
    e = F.col("pred") - F.col("actual")
    return preds.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def best_params(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """g05: the grid point with the smallest RMSE per target (ties: smaller parameters).

    Windows longer than the history hold the same rows; their RMSE differ by
    the noise of summation only. Equal to ``digits`` decimals is a tie.
    """
    best = F.min_by(F.struct("prior_length", "rho", "rmse", "mae"), F.struct(F.round("rmse", digits), "prior_length", "rho"))
    return metrics.where(F.col("rmse").isNotNull()).groupBy("target").agg(best.alias("b")).select("target", "b.*")


def error_median(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """e08: exact median absolute error per key (interpolated like pandas; NULL where no prediction exists)."""
    errors = preds.select(*keys, F.abs(F.col("pred") - F.col("actual")).alias("__e"))
    medians = exact_quantiles(errors, "__e", (0.5,), ("median_abs_error",), keys)
    return preds.select(*keys).distinct().join(medians, list(keys), "left")


# ---- i14: refit and forecast --------------------------------------------------------------------
def forecast_simple(design: DataFrame, best: DataFrame, xcol: str) -> DataFrame:
    """i14 (closed form): refit at the first future row with the best grid point, predict the future rows.

    Future rows are those with unknown y but known regressors; all of them
    share the coefficients fitted on data before the first one.
    """
    centred = _centred(design, [xcol])
    fut = _future(centred)
    first = fut.groupBy("target").agg(F.min("r").alias("r_t"))
    points = best.select("target", "prior_length", "rho").join(first, "target")
    s = _fit_simple(centred, points, xcol).select("target", "slope", "intercept")
    return fut.join(s, "target").select(
        "target", "date", (F.col("m_y") + F.col("intercept") + F.col("slope") * F.col(f"c_{xcol}")).alias("forecast"))


def forecast_band(forecasts: DataFrame, design: DataFrame) -> DataFrame:
    """e07: forecast ± the sample std of the target's actual values."""
    sd = design.where(F.col("y").isNotNull()).groupBy("target").agg(F.stddev_samp("y").alias("sd"))
    f = forecasts.join(sd, "target")
    return f.select("target", "date", "forecast", (F.col("forecast") - F.col("sd")).alias("lower"),
                    (F.col("forecast") + F.col("sd")).alias("upper"))


# ---- i13 / i14: several regressors, batched numpy solve -----------------------------------------
def _solve_batch(p: int):
    """Function over batches: p (p + 1) / 2 cross sums and p right-hand sides a row -> b0..b(p-1)."""
    def solve(batches):
        upper = [(i, j) for i in range(p) for j in range(i, p)]
        for pdf in batches:
            xx = np.empty((len(pdf), p, p))
            for i, j in upper:
                xx[:, i, j] = xx[:, j, i] = pdf[f"xx_{i}_{j}"].to_numpy()
            xy = pdf[[f"xy_{i}" for i in range(p)]].to_numpy(float)
            # all p×p systems of the batch at once; the pseudo-inverse handles rank-deficient windows
            beta = (np.linalg.pinv(xx, rcond=p * np.finfo(float).eps, hermitian=True) @ xy[..., None])[..., 0]
            out = pdf[["target", "prior_length", "rho", "r_t"]].copy()
            for i in range(p):
                out[f"b{i}"] = beta[:, i]
            yield out
    return solve


def _fit_multi(centred: DataFrame, points: DataFrame, xcols: Sequence[str]) -> DataFrame:
    """Coefficients b0.. (on centred and scaled columns) of every point, solved batch by batch."""
    feats = [F.lit(1.0)] + [F.col(f"c_{c}") for c in xcols]
    p = len(feats)
    terms = {f"xx_{i}_{j}": feats[i] * feats[j] for i in range(p) for j in range(i, p)}
    terms |= {f"xy_{i}": feats[i] * F.col("c_y") for i in range(p)}
    sums = _discounted_sums(centred, points, xcols, terms)
    schema = "target string, prior_length int, rho double, r_t int, " + ", ".join(f"b{i} double" for i in range(p))
    return sums.mapInPandas(_solve_batch(p), schema)


def _predicted(xcols: Sequence[str]):
    pred = F.col("m_y") + F.col("b0")
    for i, c in enumerate(xcols, start=1):
        pred = pred + F.col(f"b{i}") * F.col(f"c_{c}")
    return pred


def backtest_multi(design: DataFrame, grid: DataFrame, xcols: Sequence[str], n_test: int = 4) -> DataFrame:
    """i13: weighted least squares with an intercept and several regressors, 1-step-ahead backtest.

    Spark forms the sums of every (target, grid point, origin); a
    ``mapInPandas`` step solves the small systems batch by batch. A grid point
    with ``rho = 0`` weighs nothing and keeps its rows with a NULL prediction.
    A rank-deficient window takes the smallest coefficients on columns
    measured in deviations.
    """
    xcols = list(xcols)
    centred = _centred(design, xcols, scaled=True)
    points = _grid_origins(design, grid, n_test)
    known = centred.where(F.col("y").isNotNull()).select("target", F.col("r").alias("r_t"), "date", F.col("y").alias("actual"),
                                                         "m_y", *[f"c_{c}" for c in xcols])
    out = _fit_multi(centred, points.where(F.col("rho") > 0), xcols).join(known, ["target", "r_t"])
    unweighted = points.where(F.col("rho") <= 0).join(known, ["target", "r_t"])
    cols = ["target", "prior_length", "rho", "date", "actual"]
    return out.select(*cols, _predicted(xcols).alias("pred")).unionByName(
        unweighted.select(*cols, F.lit(None).cast("double").alias("pred")))


def forecast_multi(design: DataFrame, best: DataFrame, xcols: Sequence[str]) -> DataFrame:
    """i14: refit every target's best grid point on all known rows and predict the future rows.

    One batch of systems for all targets; every future row of a target uses
    the same coefficients, fitted on data before the first of them.
    """
    xcols = list(xcols)
    centred = _centred(design, xcols, scaled=True)
    fut = _future(centred)
    points = best.select("target", "prior_length", "rho").join(fut.groupBy("target").agg(F.min("r").alias("r_t")), "target")
    coef = _fit_multi(centred, points, xcols).drop("prior_length", "rho", "r_t")
    return fut.join(coef, "target").select("target", "date", _predicted(xcols).alias("forecast"))
