"""Registered model jobs: i01, i02, i04–i10, i16–i18, g08.

The regression jobs train on the model panel (j03), materialised once in
the checkpoint folder because every fit and fold re-reads it.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import panel as P
from ..operators import timeseries as ts
from ..session import cut_lineage
from . import compose as C
from .jobs_panel import macro_wide
from .jobs_timeseries import REGION_COLS
from .registry import register
from .sqlviews import with_views

LABEL = "market_cap_forecast"
FEATURES = C.PANEL_NAMES + [c for _, c in REGION_COLS] + ["crisis_dummy", "gfc_recession", "change_ath", "rolling_std"]
#: The whole grid: 5 tree counts x 2 depths (MLlib's deepest is 30) x 3 leaf sizes x bootstrap or not = 60 points.
GRID_TREES, GRID_DEPTHS, GRID_LEAVES, GRID_BOOTSTRAP = (900, 950, 1000, 1050, 1100), (5, 30), (2, 3, 4), (True, False)
#: The registered job divides the tree counts by this; README has the time of one full-size fit.
TREE_SHARE = 50


def whole_panel(t):
    """The j03 panel with label, train flag and fold, the latest date (without label) too; checkpointed (it feeds many fits)."""
    p = C.model_panel(t.statements, macro_wide(t), C.company_daily(t.orders, t.customer))
    key = M.row_key("company", "date")
    return cut_lineage(p.withColumn("label", F.col(LABEL)).withColumn("is_train", M.is_train(key)).withColumn("fold", M.fold_of(key)))


def model_panel(t):
    """The rows that have a label."""
    return whole_panel(t).where(F.col("label").isNotNull())


def split(t):
    p = model_panel(t)
    return p, p.where("is_train"), p.where(~F.col("is_train"))


def features(df) -> list[str]:
    """Model inputs that exist (a statement item dropped as mostly zero has no column)."""
    return [c for c in FEATURES if c in df.columns]


# ---- SQL-checked ---------------------------------------------------------------------------------
@register("i01_seeded_split", with_views(["panel_customer"], """
SELECT company, date, substring(md5(concat_ws('|', CAST(company AS VARCHAR), CAST(date AS VARCHAR)) || '42'), 1, 2) < 'c0' AS is_train,
       CAST(floor((instr('0123456789abcdef', substring(md5(concat_ws('|', CAST(company AS VARCHAR), CAST(date AS VARCHAR)) || '42fold'), 1, 1)) - 1) / 4) AS INTEGER) AS fold
FROM panel_customer"""))
def i01(t):
    """Stable 75/25 split and 4 folds from an md5 of (company, date)."""
    key = M.row_key("company", "date")
    return t.panel("customer").select("company", "date", M.is_train(key).alias("is_train"), M.fold_of(key).alias("fold"))


SCALE_COLS = ["market_cap", "avg_order", "max_order", "filled_share"]


@register("i02_minmax_scale", with_views(["panel"], "SELECT company, date, " + ", ".join(
    f"round(coalesce(({c} - s.{c}_lo) / nullif(s.{c}_hi - s.{c}_lo, 0), CASE WHEN {c} IS NOT NULL THEN 0.0 END), 6) AS {c}"
    for c in SCALE_COLS) + " FROM panel, (SELECT " + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in SCALE_COLS)
    + " FROM panel) s"))
def i02(t):
    """Min-max scaling of the panel measures (constant column -> 0)."""
    p = t.panel("nation").select("company", "date", *SCALE_COLS)
    return M.minmax_scale(p, SCALE_COLS)


@register("i10_closest_to_centroid", with_views(["vectors"], """
SELECT cluster, arg_min(id, (dist, id)) AS id, round(min(dist), 6) AS dist FROM (
  SELECT e.id, e.cluster, sqrt(sum((e.x - c.cx) * (e.x - c.cx))) AS dist
  FROM (SELECT id, cluster, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM vectors) e
  JOIN (SELECT cluster, d, avg(x) AS cx FROM (SELECT cluster, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM vectors)
        GROUP BY cluster, d) c USING (cluster, d)
  GROUP BY e.id, e.cluster)
GROUP BY cluster"""))
def i10(t):
    """Per given cluster label, the embedding nearest its centroid."""
    return M.closest_to_centroid(t.vectors, "cluster")


# ---- model fits (rows-only checks) ------------------------------------------------------------------
@register("i04_feature_matrix")
def i04(t):
    """Assembled feature vectors of the model panel (rows with a NULL feature skipped)."""
    p = model_panel(t)
    return M.assembler(features(p)).transform(p).select("company", "date", vector_to_array("features").alias("features"), "label")


@register("i05_random_forest")
def i05(t):
    """Random forest on the train split; predictions for the test split."""
    _, tr, te = split(t)
    _, pred = M.fit_predict(tr, te, features(tr), M.forest())
    return pred.select("company", "date", "label", "prediction")


@register("i05_scaled_forest")
def i05_scaled(t):
    """Scaled features and label: scaler, forest and inverse scaling kept together."""
    p, tr, te = split(t)
    stats = M.minmax_stats(tr, ["label"])
    _, pred = M.fit_predict(M.minmax_scale(tr, ["label"], stats), te, features(tr), M.forest(), scale=True)
    back = pred.withColumn("prediction", F.col("prediction") * (stats["label_max"] - stats["label_min"]) + stats["label_min"])
    return back.select("company", "date", "label", "prediction")


@register("i06_grid_search")
def i06(t):
    """Cross-validated forest grid: 60 combinations × 4 folds, RMSE per combination (tree counts over ``TREE_SHARE``)."""
    _, tr, _ = split(t)
    return M.forest_grid(tr, features(tr), [n // TREE_SHARE for n in GRID_TREES], GRID_DEPTHS, GRID_LEAVES, GRID_BOOTSTRAP)


@register("i07_feature_importances")
def i07(t):
    """Forest feature importances with feature names."""
    _, tr, te = split(t)
    model, _ = M.fit_predict(tr, te, features(tr), M.forest())
    return t.spark.createDataFrame(M.importances(model, features(tr)), "feature string, importance double")


@register("g08_importance_rank")
def g08(t):
    """Features ranked by importance."""
    _, tr, te = split(t)
    model, _ = M.fit_predict(tr, te, features(tr), M.forest())
    return M.rank_importances(t.spark, M.importances(model, features(tr)))


@register("i08_score_latest")
def i08(t):
    """Fit on the train split, score the latest date: (company, forecast, actual)."""
    full = whole_panel(t)
    tr = full.where(F.col("label").isNotNull() & F.col("is_train"))
    model, _ = M.fit_predict(tr, tr, features(tr), M.forest())
    out = M.score_latest(model, full)
    return out.select("company", F.col("prediction").alias("market_cap_forecast"), "market_cap")


@register("i09_kmeans_embeddings")
def i09(t):
    """k-means (k=10, seed 42) over the sentence embeddings."""
    return M.kmeans_embeddings(t.vectors, 10, 42)


@register("i16_lasso_cv")
def i16(t):
    """L1 regression, regParam chosen by 5-fold CV; test-split predictions."""
    _, tr, te = split(t)
    tr = tr.withColumn("fold", M.fold_of(M.row_key("company", "date"), folds=5))
    model, _, _ = M.grid_search(tr, features(tr), {"regParam": [0.1, 0.01, 0.001, 0.0001]}, base=M.lasso())
    return model.transform(te).select("company", "date", "label", "prediction")


@register("i16_elastic_net")
def i16_elastic_net(t):
    """Elastic net (regParam 0.1, mixing 0.1) on scaled features; test-split predictions."""
    _, tr, te = split(t)
    _, pred = M.fit_predict(tr, te, features(tr), M.lasso(0.1, 0.1), scale=True)
    return pred.select("company", "date", "label", "prediction")


@register("i17_boosted_trees")
def i17(t):
    """Gradient-boosted trees; test-split predictions."""
    _, tr, te = split(t)
    _, pred = M.fit_predict(tr, te, features(tr), M.boosted())
    return pred.select("company", "date", "label", "prediction")


@register("i18_company_clusters")
def i18(t):
    """k-means (k=5) on each company's standardised last observation."""
    cols = ["market_cap", "shares", "avg_order", "max_order", "urgent", "filled_share"]
    p = t.panel("customer").select("company", "date", *[F.col(c).cast("double").alias(c) for c in cols])
    last = P.last_per_column(p, "company", "date", cols)
    return M.company_clusters(last, cols, 5, 42)
