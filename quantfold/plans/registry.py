"""Query registry: name -> (spark, dataset_dir) -> DataFrame, plus SQL oracles.

Each registered job reads the raw tables of ``dataset_dir`` through
``Tables`` (so its work grows with them) and rounds floating columns to a
fixed number of digits so that results compare exactly with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def finalize(df: DataFrame, digits: int | dict = 6) -> DataFrame:
    """Round double/float columns (``digits`` may map column -> digits)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = digits.get(f.name, digits.get("*", 6)) if isinstance(digits, dict) else digits
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), d).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def register(name: str, sql: str | None = None, digits: int | dict = 6):
    """Register ``fn(tables) -> DataFrame`` as query ``name`` with its oracle SQL."""
    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            return finalize(_fn(Tables(spark, sf_dir)), digits)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


JOB_MODULES = ("jobs_portfolio", "jobs_timeseries", "jobs_panel", "jobs_text",
               "jobs_links", "jobs_sources", "jobs_forecast", "jobs_models")


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    import importlib.util
    for m in JOB_MODULES:
        if importlib.util.find_spec(f"{__package__}.{m}") is not None:
            importlib.import_module(f"{__package__}.{m}")
