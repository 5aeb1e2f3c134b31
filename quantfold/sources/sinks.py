"""Sinks (a09–a11): CSV / text / partitioned parquet, always to a caller-given path.

Scratch output of the registered round-trip jobs goes under the session's
``spark.checkpoint.dir`` (the cluster's shared folder), never a local temp dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quantfold-io/{name}-{uuid.uuid4().hex[:12]}"


def write_csv(df: DataFrame, path: str) -> str:
    """a09: CSV with a header."""
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    return path


def write_lines(df: DataFrame, col: str, path: str) -> str:
    """a09: one text line per row."""
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)
    return path


def write_table(df: DataFrame, path: str, partition_by=None) -> str:
    """a10: parquet, optionally partitioned (e.g. by model)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return path


def write_joined_text(df: DataFrame, col: str, order, path: str, sep: str = ". ") -> str:
    """a11: the ordered texts as one document — every piece but the last ends with ``sep``.

    The rows move once, into ordered partitions; the part files read in order
    are the joined text, one piece per line, and no single task holds it all.
    """
    from ..operators.ranking import numbered
    ranked = numbered(df, list(order), total="size")
    piece = F.when(F.col("rank") < F.col("size"), F.concat(F.col(col), F.lit(sep))).otherwise(F.col(col))
    ranked.select(piece.alias("value")).write.mode("overwrite").text(path)
    return path


def write_cluster_texts(df: DataFrame, cluster: str, col: str, order, path: str, sep: str = ". ", only=None) -> str:
    """a11: one joined text per cluster, a folder each; ``only`` writes the chosen cluster alone.

    Rows are numbered within their cluster by one move of the table, so a
    cluster with most of the rows spans many part files, in order.
    """
    from ..operators.ranking import numbered
    chosen = df if only is None else df.where(F.col(cluster).eqNullSafe(F.lit(only)))
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranked = numbered(chosen, by, [cluster], total="size")
    piece = F.when(F.col("rank") < F.col("size"), F.concat(F.col(col), F.lit(sep))).otherwise(F.col(col))
    ranked.select(F.col(cluster).alias("cluster"), piece.alias("value")).write.mode("overwrite").partitionBy("cluster").text(path)
    return path
