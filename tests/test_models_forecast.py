"""Model and forecasting properties: scaling, split stability, backtests vs numpy brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantfold.operators import forecast as FC
from quantfold.operators import models as M
from conftest import rows


def test_minmax_constant_is_zero_and_inverse(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, 5.0)], "a double, b double")
    stats = M.minmax_stats(df, ["a", "b"])
    sc = M.minmax_scale(df, ["a", "b"], stats)
    assert sorted(rows(sc)) == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
    back = M.minmax_inverse(sc, ["a"], stats)
    assert sorted(r[0] for r in rows(back, "a")) == [1.0, 2.0, 3.0]


def test_split_is_stable_under_repartitioning(spark):
    df = spark.range(2000).withColumn("d", F.lit("2020-06-30"))
    key = M.row_key("id", "d")
    a = dict(rows(df.select("id", M.is_train(key).alias("t"))))
    b = dict(rows(df.repartition(13).select("id", M.is_train(key).alias("t"))))
    assert a == b
    share = sum(a.values()) / len(a)
    assert 0.70 < share < 0.80
    folds = {r[0] for r in rows(df.select(M.fold_of(key)))}
    assert folds == {0, 1, 2, 3}


def _design(spark, n=14, seed=3):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 2.0 + 1.5 * x1 - 0.7 * x2 + rng.normal(scale=0.1, size=n)
    data = [("s", dt.date(2000, 1, 1) + dt.timedelta(days=90 * i), float(y[i]), float(x1[i]), float(x2[i]), i + 1)
            for i in range(n)]
    return spark.createDataFrame(data, "target string, date date, y double, x1 double, x2 double, r int"), x1, x2, y


def _wls(X, y, w):
    W = np.sqrt(w)[:, None]
    return np.linalg.lstsq(X * W, y * W[:, 0], rcond=None)[0]


def test_closed_form_backtest_matches_numpy(spark):
    d, x1, _, y = _design(spark)
    grid = spark.createDataFrame([("s", 6, 0.8), ("s", 50, 0.5)], "target string, prior_length int, rho double")
    got = {(pl, rho, r): p for pl, rho, r, p in
           rows(FC.backtest_simple(d, grid, "x1", 3).withColumn("r", F.dayofyear("date")), "prior_length", "rho", "date", "pred")}
    n = len(y)
    for pl, rho in [(6, 0.8), (50, 0.5)]:
        for k in range(3):
            rt = n - k  # 1-based origin index
            idx = [i for i in range(max(1, rt - pl), rt)]
            X = np.column_stack([np.ones(len(idx)), x1[[i - 1 for i in idx]]])
            w = np.array([rho ** (rt - 1 - i) for i in idx])
            b = _wls(X, y[[i - 1 for i in idx]], w)
            date = dt.date(2000, 1, 1) + dt.timedelta(days=90 * (rt - 1))
            assert got[(pl, rho, date)] == pytest.approx(b[0] + b[1] * x1[rt - 1], rel=1e-9)


def test_multi_backtest_matches_numpy(spark):
    d, x1, x2, y = _design(spark, n=16)
    grid = spark.createDataFrame([("s", 10, 0.9)], "target string, prior_length int, rho double")
    got = {dd: p for dd, p in rows(FC.backtest_multi(d, grid, ["x1", "x2"], 2), "date", "pred")}
    n = len(y)
    for k in range(2):
        rt = n - k
        idx = list(range(max(1, rt - 10), rt))
        X = np.column_stack([np.ones(len(idx)), x1[[i - 1 for i in idx]], x2[[i - 1 for i in idx]]])
        b = _wls(X, y[[i - 1 for i in idx]], np.array([0.9 ** (rt - 1 - i) for i in idx]))
        date = dt.date(2000, 1, 1) + dt.timedelta(days=90 * (rt - 1))
        assert got[date] == pytest.approx(b[0] + b[1] * x1[rt - 1] + b[2] * x2[rt - 1], rel=1e-8)


def test_parameter_grid_matches_linspace(spark):
    g = FC.parameter_grid(spark.createDataFrame([("s",)], "target string"), 7)
    pls = sorted({r[0] for r in rows(g, "prior_length")})
    assert pls == sorted(set(int(v) for v in np.ceil(np.linspace(7, 50, 10))))
    rhos = sorted({round(r[0], 12) for r in rows(g, "rho")})
    assert rhos == [round(v, 12) for v in np.linspace(0, 1, 10)]


def test_closest_to_centroid(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.9, 0.1], 0), (4, [5.0, 5.0], 1)],
                               "id long, embedding array<float>, cluster int")
    out = {c: i for c, i, _ in rows(M.closest_to_centroid(df, "cluster"))}
    assert out == {0: 3, 1: 4}


@pytest.mark.parametrize("folds", [3, 4, 5, 20])
def test_folds_are_all_used_and_nothing_else(spark, folds):
    df = spark.range(3000).withColumn("d", F.lit("x"))
    got = {r[0]: r[1] for r in df.groupBy(M.fold_of(M.row_key("id", "d"), folds=folds).alias("f")).count().collect()}
    assert set(got) == set(range(folds)) and min(got.values()) > 3000 / folds / 2


def test_prefix_of_a_forest_is_the_mean_of_its_first_trees(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    y = x[:, 0] * 2 + np.sin(3 * x[:, 1]) + rng.normal(size=60) / 10
    df = spark.createDataFrame([(int(i), int(i % 4), float(y[i]), *map(float, x[i])) for i in range(60)],
                               "id int, fold int, label double, a double, b double, c double")
    v = M.assembler(["a", "b", "c"]).transform(df)
    model = M.forest(6, 4).fit(v)
    got = {(r["id"], r["n_trees"]): r["prediction"]
           for r in M.prefix_predictions(model, v.select("id", "features"), [1, 4, 6], str(tmp_path / "m")).collect()}
    whole = {r["id"]: r["prediction"] for r in model.transform(v).collect()}
    for r in v.collect():
        each = [tree.predict(r["features"]) for tree in model.trees]
        for n in (1, 4, 6):
            assert got[r["id"], n] == pytest.approx(np.mean(each[:n]), rel=1e-12)
        assert got[r["id"], 6] == pytest.approx(whole[r["id"]], rel=1e-12)


def test_forest_grid_has_every_point_and_its_fold_errors(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(i % 2), float(v), float(v ** 2)) for i, v in enumerate(rng.normal(size=40))], "fold int, a double, label double")
    got = {(r["num_trees"], r["max_depth"], r["min_instances"], r["bootstrap"]): r["rmse"]
           for r in M.forest_grid(df, ["a"], [2, 5], [2, 4], [1], [True, False]).collect()}
    assert len(got) == 8
    # without bootstrap a forest of five equal trees predicts as one tree does
    v = M.assembler(["a"]).transform(df)
    errors = []
    for fold in (0, 1):
        model = M.forest(5, 4, minInstancesPerNode=1, bootstrap=False).fit(v.where(v.fold != fold))
        errors.append(np.sqrt(np.mean([(r["prediction"] - r["label"]) ** 2 for r in model.transform(v.where(v.fold == fold)).collect()])))
    assert got[5, 4, 1, False] == pytest.approx(np.mean(errors), rel=1e-9) == pytest.approx(got[2, 4, 1, False])


def test_multi_forecast_matches_numpy(spark):
    d, x1, x2, y = _design(spark, n=16)
    known = d.withColumn("y", F.when(F.col("r") <= 14, F.col("y")))
    best = spark.createDataFrame([("s", 10, 0.9, 1.0, 1.0)], "target string, prior_length int, rho double, rmse double, mae double")
    got = {r["date"]: r["forecast"] for r in FC.forecast_multi(known, best, ["x1", "x2"]).collect()}
    idx = list(range(4, 14))  # the ten known rows before the first unknown one, 0-based
    X = np.column_stack([np.ones(10), x1[idx], x2[idx]])
    b = _wls(X, y[idx], np.array([0.9 ** (13 - i) for i in idx]))
    want = {dt.date(2000, 1, 1) + dt.timedelta(days=90 * i): b[0] + b[1] * x1[i] + b[2] * x2[i] for i in (14, 15)}
    assert got == {k: pytest.approx(v, rel=1e-8) for k, v in want.items()}


def test_all_window_lengths_come_from_one_pass(spark):
    d, *_ = _design(spark)
    grid = FC.parameter_grid(spark.createDataFrame([("s",)], "target string"), 3)
    plan = FC.backtest_simple(d, grid, "x1")._jdf.queryExecution().optimizedPlan().toString()
    ages = [line for line in plan.split("\n") if "Generate explode(sequence(0, (element_at(" in line]
    assert len(ages) == 1 and "prior_length" not in ages[0]
