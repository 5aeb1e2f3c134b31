"""Exact quantiles against numpy and the greedy drop list against a walk by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantfold.operators import panel as P
from quantfold.operators.quantiles import exact_quantiles

QS, NAMES = (0.0, 0.25, 0.5, 0.9, 1.0), ("q0", "q25", "q50", "q90", "q100")


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)


@pytest.mark.parametrize("values", [
    [7.5] * 3000,                                        # one value in every row
    list(np.random.default_rng(1).permutation(3000) * 1.0),  # all distinct
    [1.0] * 2000 + [float(i) for i in range(500)],       # a hot value among distinct ones
    [1e300, -1e300, 5e-324, 0.0, -0.0] * 300 + [3.0],    # every magnitude
    [math.inf] * 40 + [-math.inf] * 701 + [0.1 * i for i in range(900)] + [1.7e308, -1.7e308] * 30,  # infinite ends
    list(np.random.default_rng(2).standard_cauchy(3001)),
    [4.0], [1.0, 2.0],
])
def test_quantiles_equal_numpy(spark, values):
    got = exact_quantiles(frame(spark, values), "x", QS, NAMES, most=40, buckets=8).first()
    want = np.quantile(np.array(values), QS, method="linear") if np.isfinite(values).all() else [
        sorted(values)[int(q * (len(values) - 1))] for q in QS]  # 1,701 values: whole ranks
    assert [got[n] for n in NAMES] == pytest.approx(list(want), rel=1e-12, abs=1e-300)


def test_quantiles_by_key_ignore_missing_values(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in (("a", 900), (None, 50), ("b", 1)) for v in rng.normal(size=n)]
    df = spark.createDataFrame(rows + [("a", None), ("a", math.nan), ("c", None)], "k string, x double")
    got = {r["k"]: [r[n] for n in NAMES] for r in exact_quantiles(df, "x", QS, NAMES, ["k"], most=30, buckets=4).collect()}
    assert set(got) == {"a", None, "b"}
    for k, values in got.items():
        assert values == pytest.approx(list(np.quantile([v for key, v in rows if key == k], QS)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "x double")
    assert exact_quantiles(none, "x", QS, NAMES).collect() == []
    assert P.quartile_label(spark.createDataFrame([(None,), (math.nan,)], "x double"), "x").where("quartile IS NOT NULL").count() == 0


def test_quartiles_sort_no_whole_column(spark):
    df = frame(spark, [float(i) for i in range(100)])
    plan = exact_quantiles(df, "x", (0.5,), ("m",), most=10, buckets=4)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "SinglePartition" not in plan.split("Optimized")[0]
    assert "CartesianProduct" not in plan


def drop(spark, pairs, columns):
    corr = spark.createDataFrame(pairs, "a string, b string, r double")
    return sorted(r[0] for r in P.correlated_drop_list(corr, columns, 0.75).collect())


def test_drop_list_is_greedy(spark):
    assert drop(spark, [("a", "b", 0.9), ("b", "c", -0.8), ("a", "c", 0.1)], "abc") == ["b"]
    assert drop(spark, [("a", "b", 0.9), ("a", "c", 0.9), ("b", "c", 0.9)], "abc") == ["b", "c"]
    assert drop(spark, [("a", "b", 0.5), ("b", "c", None), ("a", "c", 0.75)], "abc") == []
    # a chain of 30: every second one goes
    names = [f"v{i:02d}" for i in range(30)]
    assert drop(spark, [(x, y, 0.99) for x, y in zip(names, names[1:])], names) == names[1::2]
