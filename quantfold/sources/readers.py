"""Sources: typed readers and source-shaped operators (a01–a08, a12).

Readers always pass a schema (no inference pass over the data) and keep
provenance as columns (``_metadata.file_path``), never as dict keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def price_window(prices: DataFrame, tickers: DataFrame, start: str, end: str) -> DataFrame:
    """a07: closes of the listed tickers for start <= date < end.

    The date bounds are plain comparisons on the partition/date column, so
    they reach the scan as pushed filters; the ticker list is a semi join.
    """
    return (prices
            .where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))
            .join(tickers.select("ticker").distinct(), "ticker", "left_semi")
            .select("ticker", "date", "close"))


STATEMENT_SCHEMA = "company bigint, item string, period date, value double, sheet string"
MACRO_SCHEMA_HEAD = "date date"


def read_statements(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """a01: statement files (one folder per sheet) -> long rows with their source file.

    The sheet is a partition column of the folder layout, so a filter on it
    prunes whole folders; the schema is given, never inferred.
    """
    df = spark.read.schema(STATEMENT_SCHEMA).format(fmt).load(path)
    return df.select("company", "sheet", "item", "period", "value", F.col("_metadata.file_path").alias("source_file"))


def read_macro_csv(spark, path: str, value_cols) -> DataFrame:
    """a02: CSV with a typed date key and typed numeric columns (no inference)."""
    schema = ", ".join([MACRO_SCHEMA_HEAD] + [f"{c} double" for c in value_cols] + ["crisis_dummy int"])
    return spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def unpair_series(df: DataFrame, pairs) -> DataFrame:
    """a03: side-by-side (date_i, value_i) column pairs -> long (series, obs_date, value), empty cells dropped."""
    stack = ", ".join(f"'{name}', `{d}`, `{v}`" for name, d, v in pairs)
    long = df.selectExpr(f"stack({len(pairs)}, {stack}) AS (series, obs_date, value)")
    return long.where(F.col("obs_date").isNotNull() & F.col("value").isNotNull())


def read_lines(spark, path: str) -> DataFrame:
    """a04: headerless text, one row per line."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def list_files(spark, path: str, suffix: str) -> DataFrame:
    """a05: files under ``path`` whose name ends with ``suffix`` (recursive, glob filtered)."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
          .option("recursiveFileLookup", True).load(path))
    return df.select("path", "length")


def load_pages(pages: DataFrame, report_col: str, page_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """a06: (pages with their position inside the report, rejected rows).

    Unreadable pages (NULL or empty text) go to the reject output instead of
    failing the job; positions follow the pages' own order. A report with
    most of all pages is numbered over many partitions.
    """
    from ..operators.ranking import numbered
    ok = F.col(text_col).isNotNull() & (F.length(text_col) > 0)
    good = numbered(pages.where(ok), [F.col(page_col)], [report_col], name="page_in_report")
    return good.withColumn("page_in_report", F.col("page_in_report").cast("int")), pages.where(~ok)


def sector_members(companies: DataFrame, sector: str) -> DataFrame:
    """a08: codes and names of one sector."""
    return companies.where(F.col("sector") == sector).select("code", "company", "sector")
