"""The domain views of ``quantfold.sources.views`` as DuckDB CTEs.

Oracle queries name the views they need; ``with_views`` prepends them (and
their dependencies) as a WITH clause over the raw tables.
"""

from __future__ import annotations

HALF_YEAR_END = ("CASE WHEN month({d}) <= 6 THEN make_date(year({d}), 6, 30) "
                 "ELSE make_date(year({d}), 12, 31) END")


def rnd(expr: str, d: int = 6) -> str:
    """DuckDB rounding that matches Spark's ``round`` on doubles.

    Spark rounds the shortest decimal string of the double HALF_UP; DuckDB's
    ``round`` scales the binary value. Casting through VARCHAR to an exact
    DECIMAL first makes both agree on exact-half ties.
    """
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38, 18)), {d}) AS DOUBLE)"


def hye(d: str) -> str:
    return HALF_YEAR_END.format(d=d)


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "prices": ((), """
        SELECT user_id AS ticker, CAST(ts AS DATE) AS date, max_by(value, ts) AS close
        FROM events GROUP BY 1, 2"""),
    "index_prices": (("prices",), """
        SELECT date, avg(close) AS close FROM prices GROUP BY date"""),
    "forecasts": (("prices",), """
        SELECT ticker, min_by(close, date) AS market_cap, avg(close) AS market_cap_forecast
        FROM prices WHERE close IS NOT NULL GROUP BY ticker"""),
    "panel": ((), f"""
        SELECT CAST(c_nationkey AS BIGINT) AS company, {hye('CAST(o_orderdate AS DATE)')} AS date,
               sum(o_totalprice) AS market_cap, count(*) AS shares,
               avg(o_totalprice) AS avg_order, max(o_totalprice) AS max_order,
               CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS urgent,
               avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)::DOUBLE AS filled_share
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""),
    "panel_customer": ((), f"""
        SELECT CAST(c_custkey AS BIGINT) AS company, {hye('CAST(o_orderdate AS DATE)')} AS date,
               sum(o_totalprice) AS market_cap, count(*) AS shares,
               avg(o_totalprice) AS avg_order, max(o_totalprice) AS max_order,
               CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS urgent,
               avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)::DOUBLE AS filled_share
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""),
    "stmt_wide": ((), f"""
        SELECT CAST(s_nationkey AS BIGINT) AS company, {hye('CAST(l_shipdate AS DATE)')} AS period,
          sum(l_extendedprice * (1 - l_discount)) AS revenue,
          sum(l_extendedprice * (1 - l_discount) * l_tax) AS tax,
          sum(l_extendedprice) AS mcap,
          sum(l_quantity) AS units,
          sum(l_extendedprice * l_discount) AS discounts,
          sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0 END) AS returns_,
          avg(l_extendedprice / nullif(l_quantity, 0)) AS share_price,
          avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE AS return_rate
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""),
    "statements": (("stmt_wide",), """
        SELECT company, 'Profit Loss' AS sheet, 'Revenue' AS item, period, revenue AS value FROM stmt_wide
        UNION ALL SELECT company, 'Profit Loss', 'Tax', period, tax FROM stmt_wide
        UNION ALL SELECT company, 'Balance Sheet', 'Market Cap.', period, mcap FROM stmt_wide
        UNION ALL SELECT company, 'Balance Sheet', 'Units', period, units FROM stmt_wide
        UNION ALL SELECT company, 'Cash Flow', 'Discounts', period, discounts FROM stmt_wide
        UNION ALL SELECT company, 'Cash Flow', 'Returns', period, returns_ FROM stmt_wide
        UNION ALL SELECT company, 'Ratio Analysis', 'Share Price', period, share_price FROM stmt_wide
        UNION ALL SELECT company, 'Ratio Analysis', 'Return Rate', period, return_rate FROM stmt_wide"""),
    "macro_obs": ((), """
        SELECT r_name AS series, CAST(o_orderdate AS DATE) AS obs_date, o_totalprice AS value,
               o_orderkey AS obs_id
        FROM orders JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey"""),
    "doc_pages": ((), """
        SELECT source AS report_id, doc_id AS page_no, text AS content FROM documents"""),
    "minutes": ((), """
        SELECT item_id AS doc_id, text AS content FROM benchmark"""),
    "companies": ((), """
        SELECT c_custkey AS code, c_name AS company, c_mktsegment AS sector FROM customer"""),
    "vectors": ((), """
        SELECT vec_id AS id, embedding, label AS cluster FROM embeddings"""),
}


def _resolve(names, seen, order):
    for n in names:
        if n in seen:
            continue
        deps, _ = VIEWS[n]
        _resolve(deps, seen, order)
        seen.add(n)
        order.append(n)


def with_views(needs: list[str] | tuple[str, ...], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``WITH <views...>, <extra ctes...> <body>``."""
    order: list[str] = []
    _resolve(needs, set(), order)
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in extra]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
