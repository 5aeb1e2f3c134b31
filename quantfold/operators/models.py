"""Model jobs on the panel and on embeddings (i01–i10, i16–i18, g08).

* Splits and folds come from an md5 of the row key, not ``randomSplit``:
  membership is the same however the data is partitioned or retried.
* Scaling statistics are one aggregate row read as a scalar subquery.
* Estimators are MLlib (distributed fits); a scaler always travels with
  its model inside one ``Pipeline``.
* Embedding centroids are ``Summarizer.mean`` per cluster (k rows), joined
  back many-to-one; distances are array expressions, no explode per dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import safe_div
from ..session import cut_lineage


# ---- i01: split and folds --------------------------------------------------------------
def row_key(*cols) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def is_train(key: Column, seed: int = 42) -> Column:
    """i01: 75/25 split — first two hex digits of md5(key || seed) below 'c0' (192/256)."""
    return F.substring(F.md5(F.concat(key, F.lit(str(seed)))), 1, 2) < F.lit("c0")


def fold_of(key: Column, seed: int = 42, folds: int = 4) -> Column:
    """Fold number 0..folds-1: the first 32 bits of a second md5 as a fraction of the whole, times ``folds``."""
    h = F.substring(F.md5(F.concat(key, F.lit(f"{seed}fold"))), 1, 8)
    return F.shiftright(F.conv(h, 16, 10).cast("long") * F.lit(folds), 32).cast("int")


# ---- i02: min-max scaling ------------------------------------------------------------------
def minmax_stats(df: DataFrame, cols: Sequence[str]) -> Column:
    """One scalar subquery with every column's min and max (a struct)."""
    return df.select(F.struct(*[F.min(c).alias(f"{c}_min") for c in cols],
                              *[F.max(c).alias(f"{c}_max") for c in cols]).alias("s")).scalar()


def minmax_scale(df: DataFrame, cols: Sequence[str], stats: Column | None = None) -> DataFrame:
    """i02: (x - min) / (max - min); a constant column scales to 0."""
    s = stats if stats is not None else minmax_stats(df, cols)
    return df.withColumns({c: F.coalesce(safe_div(F.col(c) - s[f"{c}_min"], s[f"{c}_max"] - s[f"{c}_min"]),
                                         F.when(F.col(c).isNotNull(), F.lit(0.0)))
                           for c in cols})


def minmax_inverse(df: DataFrame, cols: Sequence[str], stats: Column) -> DataFrame:
    """Inverse of ``minmax_scale``."""
    return df.withColumns({c: F.col(c) * (stats[f"{c}_max"] - stats[f"{c}_min"]) + stats[f"{c}_min"] for c in cols})


# ---- i04..i08: regression on the panel ------------------------------------------------------
def assembler(features: Sequence[str]) -> VectorAssembler:
    """i04: feature vector; rows with a NULL feature are skipped."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")


def forest(num_trees: int = 50, max_depth: int = 10, seed: int = 42, **kw) -> RandomForestRegressor:
    """i05: random forest; every feature considered at each split."""
    return RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                 featureSubsetStrategy="all", labelCol="label", featuresCol="features", **kw)


def fit_predict(train: DataFrame, test: DataFrame, features: Sequence[str], estimator, scale: bool = False):
    """Fit ``assembler (→ MinMaxScaler) → estimator`` as one pipeline; predictions on ``test``."""
    stages = [assembler(features)]
    if scale:
        stages[0].setOutputCol("raw_features")
        stages.append(MinMaxScaler(inputCol="raw_features", outputCol="features"))
    stages.append(estimator)
    model = Pipeline(stages=stages).fit(train)
    return model, model.transform(test)


def grid_search(train: DataFrame, features: Sequence[str], grid_spec: dict, fold_col: str = "fold",
                parallelism: int = 4, base=None):
    """i06: cross-validated grid search (RMSE), folds from ``fold_col``, best model refit on all folds."""
    est = base or forest()
    pipe = Pipeline(stages=[assembler(features), est])
    builder = ParamGridBuilder()
    for name, values in grid_spec.items():
        builder = builder.addGrid(est.getParam(name), list(values))
    grid = builder.build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, numFolds=max(2, train.select(fold_col).distinct().count()),
                        evaluator=RegressionEvaluator(labelCol="label", metricName="rmse"),
                        foldCol=fold_col, parallelism=parallelism, seed=42)
    model = cv.fit(train)
    rows = [({p.name: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
              for p, v in pm.items()}, m) for pm, m in zip(grid, model.avgMetrics)]
    return model, rows, grid_spec


def prefix_predictions(model, rows: DataFrame, sizes: Sequence[int], path: str) -> DataFrame:
    """(rows' columns, n_trees, prediction): what the first n trees of a fitted forest predict, for every n of ``sizes``.

    One forest serves all tree counts. The leaf of every tree is read with
    ``transform``; the leaves' values come from the stored model, where a
    tree's nodes are numbered in order. ``path`` gets a copy of the model.
    """
    spark = rows.sparkSession
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").where("leftChild = -1")
    leaf_no = F.row_number().over(Window.partitionBy("treeID").orderBy("id")) - 1  # leaves of one tree
    leaves = nodes.select("treeID", leaf_no.alias("__leaf"), F.col("prediction").alias("__value"))
    found = model.setLeafCol("__leaves").transform(rows).withColumn("__row", F.monotonically_increasing_id())
    keep = [c for c in rows.columns if c != "features"]
    each = found.select("__row", *keep, F.posexplode(vector_to_array("__leaves")).alias("treeID", "__at"))
    each = each.withColumn("__leaf", F.col("__at").cast("int")).join(leaves, ["treeID", "__leaf"])
    wide = each.groupBy("__row", *keep).agg(*[F.avg(F.when(F.col("treeID") < n, F.col("__value"))).alias(f"__{n}") for n in sizes])
    return wide.select(*keep, F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"__{n}").alias("p")) for n in sizes])).alias("s")) \
        .select(*keep, F.col("s.n").alias("n_trees"), F.col("s.p").alias("prediction"))


def forest_grid(train: DataFrame, features: Sequence[str], trees: Sequence[int], depths: Sequence[int], leaves: Sequence[int],
                bootstrap: Sequence[bool], fold_col: str = "fold", parallelism: int = 8, seed: int = 42) -> DataFrame:
    """i06: cross-validated RMSE of every (trees, depth, leaf size, bootstrap), as rows.

    The rows are assembled once. Per (depth, leaf size, bootstrap, fold) only
    the largest forest is fitted and scored at every tree count. Without
    bootstrap every tree sees all rows and all features, so all trees are one
    tree: a single one is fitted and stands for each count.
    """
    from concurrent.futures import ThreadPoolExecutor

    from ..sources.sinks import scratch_path
    spark = train.sparkSession
    vectors = cut_lineage(assembler(features).transform(train).select("features", "label", F.col(fold_col).alias("__fold")))
    folds = sorted(r[0] for r in vectors.select("__fold").distinct().collect())  # a few fold numbers

    def fit(point) -> list[tuple]:
        depth, leaf, boot, fold = point
        estimator = forest(max(trees) if boot else 1, depth, seed, minInstancesPerNode=leaf, bootstrap=boot)
        model = estimator.fit(vectors.where(F.col("__fold") != fold))
        held = vectors.where(F.col("__fold") == fold)
        if boot:
            scored = prefix_predictions(model, held, sorted(trees), scratch_path(spark, "forest"))
        else:
            one = model.transform(held).select("label", "prediction")
            scored = one.withColumn("n_trees", F.explode(F.array(*[F.lit(n) for n in trees])))
        error = F.col("prediction") - F.col("label")
        rows = scored.groupBy("n_trees").agg(F.sqrt(F.avg(error * error)).alias("rmse")).collect()  # one row a tree count
        return [(r["n_trees"], depth, leaf, boot, fold, r["rmse"]) for r in rows]

    points = [(d, m, b, f) for d in depths for m in leaves for b in bootstrap for f in folds]
    with ThreadPoolExecutor(parallelism) as pool:
        rows = [r for rows in pool.map(fit, points) for r in rows]
    errors = spark.createDataFrame(rows, "num_trees int, max_depth int, min_instances int, bootstrap boolean, fold int, rmse double")
    return errors.groupBy("num_trees", "max_depth", "min_instances", "bootstrap").agg(F.avg("rmse").alias("rmse"))


def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """i07: (feature, importance) of the forest at the end of a fitted pipeline."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    imp = last.featureImportances.toArray()
    return [(f, float(v)) for f, v in zip(features, imp)]


def rank_importances(spark, imps: list[tuple[str, float]]) -> DataFrame:
    """g08: importances ranked (feature count rows: one per model input column)."""
    df = spark.createDataFrame(imps, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature"))


def lasso(reg: float = 0.01, enet: float = 1.0) -> LinearRegression:
    """i16: L1 (or elastic-net) linear regression."""
    return LinearRegression(regParam=reg, elasticNetParam=enet, labelCol="label", featuresCol="features", maxIter=100)


def boosted(max_iter: int = 20, max_depth: int = 5, seed: int = 42) -> GBTRegressor:
    """i17: gradient-boosted trees."""
    return GBTRegressor(maxIter=max_iter, maxDepth=max_depth, seed=seed, labelCol="label", featuresCol="features")


def score_latest(model, panel: DataFrame, date_col: str = "date") -> DataFrame:
    """i08: apply a fitted pipeline to the latest date's rows only (max date as a scalar subquery)."""
    latest = panel.select(F.max(date_col)).scalar()
    return model.transform(panel.where(F.col(date_col) == latest))


# ---- i09 / i10 / i18: clustering --------------------------------------------------------------
def kmeans_embeddings(vectors: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """i09: k-means (k-means||) over array<float> embeddings -> (id, cluster)."""
    v = vectors.select("id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=k, seed=seed, initMode="k-means||", featuresCol="features", predictionCol="cluster").fit(v)
    return model.transform(v).select("id", "cluster")


def closest_to_centroid(vectors: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """i10: per cluster the member nearest its centroid (Euclidean), with the distance."""
    v = vectors.select("id", cluster_col, array_to_vector("embedding").alias("vec"))
    cen = v.groupBy(cluster_col).agg(vector_to_array(Summarizer.mean(F.col("vec"))).alias("c"))
    j = vectors.select("id", cluster_col, F.col("embedding").cast("array<double>").alias("e")) \
               .join(F.broadcast(cen), cluster_col)  # one row per cluster: bounded by k
    d = F.sqrt(F.aggregate(F.zip_with("e", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x))
    j = j.select("id", cluster_col, d.alias("dist"))
    return j.groupBy(cluster_col).agg(F.min_by(F.struct("id", "dist"), F.struct("dist", "id")).alias("b")) \
            .select(cluster_col, "b.id", "b.dist")


def company_clusters(last_obs: DataFrame, features: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """i18: standardised last observation per company -> k-means cluster."""
    pipe = Pipeline(stages=[assembler(features).setOutputCol("raw"),
                            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
                            KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")])
    return pipe.fit(last_obs).transform(last_obs).select("company", "cluster")
