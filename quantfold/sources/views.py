"""Domain views over the raw warehouse tables.

The library's operators speak in domain tables (prices, forecasts, panels,
statements, macro observations, report pages, minutes, links). These views
derive them from the TPC-H-like tables a deployment provides, so that every
job's work grows with those tables:

=============  ==============================================================
prices         events: ticker = user_id, date = to_date(ts),
               close = last value of the day (max_by on ts)
index_prices   mean close per date (the benchmark index)
forecasts      per ticker: market_cap = first close, forecast = mean close
panel          orders ⋈ customer per (company, half-year end)
statements     lineitem ⋈ supplier per (nation, half-year), four sheets, long
macro_obs      orders ⋈ customer ⋈ nation ⋈ region: series = region name
doc_pages      documents: report = source, page = doc_id, content = text
minutes        benchmark passages (the comparison corpus)
companies      customer: code = c_custkey, sector = c_mktsegment
vectors        embeddings with their given cluster label
=============  ==============================================================

Nothing here collects or broadcasts; joins are left to the optimizer (dims
are tiny parquet files, so the static size estimate already broadcasts them).
``prices`` is the one materialised view: it is read several times per market
job and is far smaller than the event stream, so it is written once to the
checkpoint folder and the events are scanned once per job.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import half_year_end
from ..functions.nulls import nan_to_null

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


class Tables:
    """Lazy loader for raw tables and the derived domain views of one dataset."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.raw(name)
        raise AttributeError(name)

    # ---- market data -------------------------------------------------
    @functools.cached_property
    def prices(self) -> DataFrame:
        """Daily closes, written once to the checkpoint folder.

        Every market job reads prices several times (positions, growth,
        index, scalar subqueries); materialising the ticker × day table —
        far smaller than the event stream — means the events are scanned
        once per job instead of once per use.
        """
        from ..session import cut_lineage
        return cut_lineage(prices_view(self.raw("events")))

    @property
    def prices_once(self) -> DataFrame:
        """The same closes for a job that reads them a single time: nothing is written."""
        return prices_view(self.raw("events"))

    def prices_between(self, start: str, end: str) -> DataFrame:
        """Closes of start <= date < end; the bounds are on the event time, so they reach the scan."""
        events = self.raw("events")
        kind = events.schema["ts"].dataType
        inside = (F.col("ts") >= F.lit(start).cast(kind)) & (F.col("ts") < F.lit(end).cast(kind))
        return prices_view(events.where(inside))

    @property
    def tickers(self) -> DataFrame:
        """Distinct tickers, without a price table."""
        return self.raw("events").select(F.col("user_id").alias("ticker")).distinct()

    @property
    def index_prices(self) -> DataFrame:
        return index_view(self.prices)

    @property
    def forecasts(self) -> DataFrame:
        return forecasts_view(self.prices)

    # ---- statements / panels ----------------------------------------
    def panel(self, by: str = "nation") -> DataFrame:
        return panel_view(self.raw("orders"), self.raw("customer"), by)

    @property
    def statements(self) -> DataFrame:
        return statements_view(self.raw("lineitem"), self.raw("supplier"))

    @property
    def macro_obs(self) -> DataFrame:
        return macro_obs_view(self.raw("orders"), self.raw("customer"),
                              self.raw("nation"), self.raw("region"))

    # ---- text -----------------------------------------------------------
    @property
    def doc_pages(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("source").alias("report_id"),
            F.col("doc_id").alias("page_no"),
            F.col("text").alias("content"))

    @property
    def minutes(self) -> DataFrame:
        return self.raw("benchmark").select(
            F.col("item_id").alias("doc_id"), F.col("text").alias("content"))

    @property
    def companies(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("code"), F.col("c_name").alias("company"),
            F.col("c_mktsegment").alias("sector"))

    @property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster"))


def prices_view(events: DataFrame) -> DataFrame:
    return (events
            .groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"))
            .agg(F.max_by(nan_to_null("value"), "ts").alias("close")))


def index_view(prices: DataFrame) -> DataFrame:
    return prices.groupBy("date").agg(F.avg("close").alias("close"))


def forecasts_view(prices: DataFrame) -> DataFrame:
    return (prices.where(F.col("close").isNotNull())
            .groupBy("ticker")
            .agg(F.min_by("close", "date").alias("market_cap"),
                 F.avg("close").alias("market_cap_forecast")))


def panel_view(orders: DataFrame, customer: DataFrame, by: str = "nation") -> DataFrame:
    key = {"nation": "c_nationkey", "customer": "c_custkey"}[by]
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return (joined
            .groupBy(F.col(key).cast("bigint").alias("company"),
                     half_year_end(F.to_date("o_orderdate")).alias("date"))
            .agg(F.sum("o_totalprice").alias("market_cap"),
                 F.count(F.lit(1)).alias("shares"),
                 F.avg("o_totalprice").alias("avg_order"),
                 F.max("o_totalprice").alias("max_order"),
                 F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
                 F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("filled_share")))


STATEMENT_ITEMS = {
    # sheet -> list of (item, aggregate expression)
    "Profit Loss": [
        ("Revenue", lambda: F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))),
        ("Tax", lambda: F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.col("l_tax"))),
    ],
    "Balance Sheet": [
        ("Market Cap.", lambda: F.sum("l_extendedprice")),
        ("Units", lambda: F.sum("l_quantity")),
    ],
    "Cash Flow": [
        ("Discounts", lambda: F.sum(F.col("l_extendedprice") * F.col("l_discount"))),
        ("Returns", lambda: F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0))),
    ],
    "Ratio Analysis": [
        ("Share Price", lambda: F.avg(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")))),
        ("Return Rate", lambda: F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))),
    ],
}


def statements_view(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Long statements: one aggregation pass, then a single unpivot."""
    li = lineitem.join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
    aggs, cols = [], []
    for sheet, items in STATEMENT_ITEMS.items():
        for item, agg in items:
            alias = f"{sheet}|{item}"
            aggs.append(agg().alias(alias))
            cols.append(alias)
    wide = (li.groupBy(F.col("s_nationkey").cast("bigint").alias("company"),
                       half_year_end(F.to_date("l_shipdate")).alias("period"))
            .agg(*aggs))
    long = wide.unpivot(["company", "period"], [F.col(f"`{c}`") for c in cols], "key", "value")
    return long.select(
        "company", F.split("key", r"\|").getItem(0).alias("sheet"),
        F.split("key", r"\|").getItem(1).alias("item"), "period", "value")


def macro_obs_view(orders, customer, nation, region) -> DataFrame:
    return (orders
            .join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, customer.c_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .select(F.col("r_name").alias("series"),
                    F.to_date("o_orderdate").alias("obs_date"),
                    F.col("o_totalprice").alias("value"),
                    F.col("o_orderkey").alias("obs_id")))
