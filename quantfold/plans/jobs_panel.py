"""Registered panel jobs: b01–b16, b21–b25, c01–c04, c08, c09, d01–d03, d07,
e01, e02, e09, e10, e12, e13, i03, j03, j04."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.nulls import safe_div
from ..operators import panel as P
from ..operators import portfolio as pf
from ..operators import timeseries as ts
from ..session import reuse
from . import compose as C
from .jobs_timeseries import MONTHLY, REGION_COLS, region_series
from .registry import register
from .sqlviews import rnd, with_views

RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
SHEET_RANK = ("CASE sheet WHEN 'Profit Loss' THEN 1 WHEN 'Balance Sheet' THEN 2 "
              "WHEN 'Cash Flow' THEN 3 WHEN 'Ratio Analysis' THEN 4 END")
RENAME = ("CASE item WHEN 'Units' THEN 'Quantity' WHEN 'Discounts' THEN 'Cash Adjustments' "
          "WHEN 'Returns' THEN 'Cash Adjustments' ELSE item END")
STMT_CTES = [
    ("st1", f"SELECT company, sheet, {RENAME} AS item, item AS src_item, period, value FROM statements"),
    ("st2", f"""SELECT company, sheet, item, src_item, period, value FROM (
                  SELECT *, row_number() OVER (PARTITION BY company, period, item ORDER BY {SHEET_RANK}, src_item) AS rn
                  FROM st1) WHERE rn = 1"""),
    ("st3", """SELECT * FROM st2 WHERE item NOT IN (
                  SELECT item FROM st2 GROUP BY item
                  HAVING avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) > 0.5)"""),
    ("wide", "SELECT company, period AS date, " + ", ".join(
        f"max(value) FILTER (WHERE item = '{i}') AS {n}" for i, n in zip(C.PANEL_ITEMS, C.PANEL_NAMES))
     + " FROM st3 GROUP BY company, period"),
]


def r6(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# ---- b: column maintenance and filters --------------------------------------------
@register("b01_rename_synonyms", with_views(["statements"], f"""
SELECT company, sheet, {RENAME} AS item, period, round(value, 6) AS value FROM statements"""))
def b01(t):
    """Synonym renames of statement items (many-to-one)."""
    return P.rename_items(t.statements, "item", C.ITEM_RENAMES).select("company", "sheet", "item", "period", "value")


@register("b02_title_case", r"""
SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(p_name || ' ' || p_type || '/' || p_brand, '(\p{L}+|\P{L}+)', 1),
         lambda r: upper(substring(r, 1, 1)) || lower(substring(r, 2))), 'string_agg', '') AS title
FROM part""")
def b02(t):
    """Python-style title case of header-like strings."""
    s = F.concat_ws("", F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit("/"), F.col("p_brand"))
    return t.part.select("p_partkey", P.title_case(s).alias("title"))


@register("b03_drop_items", with_views(["statements"], """
SELECT company, sheet, item, period, round(value, 6) AS value FROM statements
WHERE item NOT IN ('Tax', 'Return Rate')"""))
def b03(t):
    """Drop a fixed list of statement items (long-form column drop)."""
    return P.drop_items(t.statements, "item", ["Tax", "Return Rate"])


D10_SQL = """SELECT s.company, s.date, p.market_cap, p.shares, p.urgent FROM (
  SELECT g.company, last_day(g.lo + to_months(CAST(6 * i AS INTEGER))) AS date
  FROM (SELECT company, min(date) AS lo, max(date) AS hi FROM panel_customer GROUP BY company) g,
       range(0, CAST(date_diff('month', g.lo, g.hi) // 6 AS BIGINT) + 1) r(i)) s
LEFT JOIN panel_customer p USING (company, date)"""


def reindexed(t):
    p = t.panel("customer").select("company", "date", "market_cap", "shares", "urgent")
    return ts.reindex(p, "company", "date", 6)


@register("b04_not_equal_keep_null", with_views(["panel_customer"], f"""
SELECT company, date, round(market_cap, 6) AS market_cap, shares, urgent FROM ({D10_SQL})
WHERE urgent IS DISTINCT FROM 0"""))
def b04(t):
    """``urgent != 0`` that keeps the NULL rows of missing periods."""
    return P.keep_not_equal(reindexed(t), "urgent", 0)


@register("b05_sector_members", """
SELECT c_custkey AS code, c_name AS company FROM customer WHERE c_mktsegment = 'BUILDING'""")
def b05(t):
    """Equality filter + projection (one sector's codes and names; also a08)."""
    return t.companies.where(F.col("sector") == "BUILDING").select("code", "company")


@register("b06_date_slices", with_views(["panel"], """
SELECT 'between' AS slice, company, date FROM panel WHERE date BETWEEN DATE '1996-06-30' AND DATE '1998-12-31'
UNION ALL SELECT 'upto', company, date FROM panel WHERE date <= DATE '1997-12-31'
UNION ALL SELECT 'on', company, date FROM panel WHERE date = DATE '1999-06-30'"""))
def b06(t):
    """Inclusive, open-ended and single-date slices of the panel."""
    p = t.panel("nation").select("company", "date")
    d = F.col("date")
    return (p.where(d.between(F.lit("1996-06-30").cast("date"), F.lit("1998-12-31").cast("date")))
             .select(F.lit("between").alias("slice"), "company", "date")
             .unionByName(p.where(d <= F.lit("1997-12-31").cast("date")).select(F.lit("upto").alias("slice"), "company", "date"))
             .unionByName(p.where(d == F.lit("1999-06-30").cast("date")).select(F.lit("on").alias("slice"), "company", "date")))


@register("b07_quarter_months", with_views(["macro_obs"], f"""
SELECT series, date, round(value, 6) AS value FROM ({MONTHLY}) WHERE month(date) IN (3, 6, 9, 12)"""))
def b07(t):
    """Month-of-year filter: quarter-end months of the monthly series."""
    m = ts.monthly_last(t.macro_obs, "series", "obs_date", "value", "obs_id")
    return m.where(F.month("date").isin(3, 6, 9, 12)).select("series", "date", "value")


def contains_any(c, subs):
    """b08: true when the string contains any of the substrings."""
    arr = F.array(*[F.lit(s) for s in subs])
    return F.exists(arr, lambda s: F.contains(F.col(c) if isinstance(c, str) else c, s))


@register("b08_contains_any", """
SELECT p_partkey, p_name FROM part
WHERE contains(p_name, 'red') OR contains(p_name, 'blue') OR contains(p_name, 'gear')""")
def b08(t):
    """Rows whose value contains any of several substrings."""
    return t.part.where(contains_any("p_name", ["red", "blue", "gear"])).select("p_partkey", "p_name")


@register("b09_regex_include_exclude", with_views(["doc_pages"], """
SELECT report_id, page_no FROM doc_pages
WHERE regexp_matches(content, '[A-Za-z]') AND NOT regexp_matches(content, '[0-9]{3}')"""))
def b09(t):
    """Regex include (has a letter) and exclude (has three digits in a row)."""
    d = t.doc_pages
    return d.where(F.col("content").rlike("[A-Za-z]") & ~F.col("content").rlike("[0-9]{3}")).select("report_id", "page_no")


FIND_TERMS = ["the", "and", "that", "with", "from"]


def find_terms_count(c, terms):
    """b10: number of terms found (case-insensitive regex search)."""
    return sum((F.col(c).rlike(f"(?i){t}").cast("int") for t in terms), F.lit(0))


@register("b10_find_terms", with_views(["doc_pages"], f"""
SELECT page_no, found FROM (
  SELECT page_no, {' + '.join(f"CAST(regexp_matches(content, '{t}', 'i') AS INTEGER)" for t in FIND_TERMS)} AS found
  FROM doc_pages) WHERE found / {len(FIND_TERMS)} >= 0.6"""))
def b10(t):
    """Keep texts containing at least 60 % of the terms."""
    d = t.doc_pages.select("page_no", find_terms_count("content", FIND_TERMS).alias("found"))
    # keep inside a generator: a filter on ``found`` would be pushed below the
    # projection with the five regex searches inlined, running them twice
    keep = F.when(F.col("found") / len(FIND_TERMS) >= 0.6, F.array("found")).otherwise(F.array().cast("array<int>"))
    return d.select("page_no", F.explode(keep).alias("found"))


TERM_GROUPS = [["economic", "risk"], ["the", "of", "was"], ["elle", "des", "aux"]]


@register("b11_all_terms_any_group", with_views(["doc_pages"], f"""
SELECT page_no FROM doc_pages WHERE {' OR '.join('(' + ' AND '.join(f"regexp_matches(content, '{w}', 'i')" for w in g) + ')' for g in TERM_GROUPS)}"""))
def b11(t):
    """Keep texts where every term of at least one group is present."""
    cond = None
    for g in TERM_GROUPS:
        c = None
        for w in g:
            x = F.col("content").rlike(f"(?i){w}")
            c = x if c is None else (c & x)
        cond = c if cond is None else (cond | c)
    return t.doc_pages.where(cond).select("page_no")


@register("b13_drop_nulls", with_views(["panel_customer"], f"""
SELECT company, date, round(market_cap, 6) AS market_cap, shares, urgent FROM ({D10_SQL})
WHERE market_cap IS NOT NULL AND shares IS NOT NULL AND urgent IS NOT NULL"""))
def b13(t):
    """Drop rows with any NULL after reindexing (the missing periods)."""
    return P.drop_nulls(reindexed(t))


@register("b14_dash_to_zero", with_views(["statements"], """
SELECT company, item, period, txt,
       round(TRY_CAST(CASE WHEN txt = '--' THEN '0' ELSE txt END AS DOUBLE), 6) AS value,
       TRY_CAST(sheet AS DOUBLE) AS bad_cast
FROM (SELECT company, sheet, item, period,
             CASE WHEN value = 0 THEN '--' ELSE CAST(CAST(round(CAST(CAST(value AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DECIMAL(18, 2)) AS VARCHAR) END AS txt
      FROM statements)"""))
def b14(t):
    """Textual '--' -> 0 and lossy numeric casts (bad text -> NULL)."""
    s = t.statements.withColumn(
        "txt", F.when(F.col("value") == 0, F.lit("--"))
                .otherwise(F.round("value", 2).cast("decimal(18,2)").cast("string")))
    s = P.clean_numeric_text(s, "txt", "value")
    return s.select("company", "item", "period", "txt", "value", F.col("sheet").try_cast("double").alias("bad_cast"))


@register("b15_fill_and_patch_latest", with_views(["panel_customer"], f"""
SELECT company, date, round(coalesce(market_cap, 0.0), 6) AS market_cap,
       CASE WHEN date = (SELECT max(date) FROM panel_customer) THEN 0 ELSE coalesce(urgent, 0) END AS urgent
FROM ({D10_SQL})"""))
def b15(t):
    """Constant fill of gaps, then the latest date's flag patched to 0."""
    r = reindexed(t).fillna({"market_cap": 0.0, "urgent": 0})
    return P.patch_latest(r, "date", "urgent", 0).select("company", "date", "market_cap", "urgent")


@register("b16_date_flag", with_views(["panel"], """
SELECT company, date, CASE WHEN date BETWEEN DATE '1997-06-30' AND DATE '1998-12-31' THEN 1 ELSE 0 END AS gfc_recession
FROM panel"""))
def b16(t):
    """Date-range indicator column."""
    return t.panel("nation").select("company", "date", D.date_flag("date", "1997-06-30", "1998-12-31").alias("gfc_recession"))


@register("b21_drop_every_second", with_views(["panel"], """
SELECT company, date FROM (
  SELECT company, date, row_number() OVER (PARTITION BY company ORDER BY date) AS rn FROM panel)
WHERE NOT (company = 0 AND (rn - 1) % 2 = 0)"""))
def b21(t):
    """Drop rows 1, 3, 5, ... of one entity (duplicate filings)."""
    p = t.panel("nation").select("company", "date")
    return P.drop_every_nth(p, "company", "date", 2, where=F.col("company") == 0)


@register("b22_label_points", with_views(["prices", "index_prices", "forecasts"], """
SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rn, count(*) OVER () AS n FROM index_prices)
WHERE (rn % 20 = 0 AND rn <> 0) OR rn = n - 1"""))
def b22(t):
    """Every 20th point of the curve plus the last (chart labels)."""
    c = pf.portfolio_curve(t.forecasts, t.prices, t.index_prices)
    return P.every_kth_and_last(c, "date", 20).select("date")


@register("b23_mostly_zero_items", with_views(["panel_customer"], """
SELECT item, round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM (
  UNPIVOT (SELECT company, date, market_cap, CAST(shares AS DOUBLE) AS shares, avg_order, max_order,
                  CAST(urgent AS DOUBLE) AS urgent, filled_share FROM panel_customer)
  ON market_cap, shares, avg_order, max_order, urgent, filled_share INTO NAME item VALUE value)
GROUP BY item HAVING avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) > 0.5"""))
def b23(t):
    """Items (columns) whose share of zeros is above 50 %."""
    cols = ["market_cap", "shares", "avg_order", "max_order", "urgent", "filled_share"]
    p = t.panel("customer").select("company", "date", *[F.col(c).cast("double").alias(c) for c in cols])
    return P.zero_share_items(P.stack_columns(p, ["company", "date"], cols), "item", "value", 0.5)


@register("b24_null_counts", with_views(["panel_customer"], f"""
SELECT * FROM (UNPIVOT (SELECT count(*) FILTER (WHERE market_cap IS NULL) AS market_cap,
                               count(*) FILTER (WHERE shares IS NULL) AS shares,
                               count(*) FILTER (WHERE urgent IS NULL) AS urgent FROM ({D10_SQL}))
               ON market_cap, shares, urgent INTO NAME "column" VALUE nulls)"""))
def b24(t):
    """NULL count per column."""
    return P.null_counts(reindexed(t), ["market_cap", "shares", "urgent"])


@register("b25_split_key", with_views(["statements"], """
SELECT k, split_part(k, '_', 1) AS company_part, split_part(k, '_', 2) AS sheet_part FROM (
  SELECT DISTINCT CAST(company AS VARCHAR) || '_' || sheet || '_' || CAST(year(period) AS VARCHAR) AS k FROM statements)"""))
def b25(t):
    """Composite string key split back into its fields."""
    k = t.statements.select(F.concat_ws("_", F.col("company").cast("string"), "sheet",
                                        F.year("period").cast("string")).alias("k")).distinct()
    return k.select("k", P.split_key("k", "_", 0).alias("company_part"), P.split_key("k", "_", 1).alias("sheet_part"))


# ---- c: reshape -----------------------------------------------------------------------
@register("c01_transpose_sheet", with_views(["statements"], f"SELECT company, date, {r6(C.PANEL_NAMES)} FROM wide", STMT_CTES))
def c01(t):
    """Long statements -> one row per (company, period), one column per item."""
    return C.wide_statements(t.statements)


PANEL_MEASURES = ["market_cap", "avg_order", "max_order", "filled_share"]


@register("c02_stack_measures", with_views(["panel_customer"], f"""
SELECT company, date, item, round(value, 6) AS value FROM (
  UNPIVOT (SELECT company, date, {', '.join(PANEL_MEASURES)} FROM panel_customer)
  ON {', '.join(PANEL_MEASURES)} INTO NAME item VALUE value)"""))
def c02(t):
    """Wide panel -> long (company, date, item, value)."""
    p = t.panel("customer")
    return P.stack_columns(p, ["company", "date"], PANEL_MEASURES)


@register("c03_first_wins", with_views(["statements"], "SELECT company, sheet, item, src_item, period, round(value, 6) AS value FROM st2", STMT_CTES[:2]))
def c03(t):
    """After many-to-one renames keep the first (sheet order, then source item) per key."""
    st = P.rename_items(t.statements.withColumn("src_item", F.col("item")), "item", C.ITEM_RENAMES)
    st = P.first_wins(st, ["company", "period", "item"], F.struct(C.sheet_rank(), F.col("src_item")))
    return st.select("company", "sheet", "item", "src_item", "period", "value")


@register("c04_union_files", with_views(["statements"], """
SELECT company, period, item, round(value, 6) AS value, CASE sheet WHEN 'Profit Loss' THEN NULL WHEN 'Balance Sheet' THEN 2
       WHEN 'Cash Flow' THEN 3 ELSE 4 END::INTEGER AS file_no FROM statements"""))
def c04(t):
    """Union by name of the four sheets' 'files', the first without a column that the others have (missing -> NULL)."""
    s = reuse(t.statements)  # one row per company, period and item; read once per file
    files = [s.where(F.col("sheet") == sheet).select("company", "period", "item", "value") for sheet in C.SHEET_ORDER]
    return P.union_files([files[0], *(f.withColumn("file_no", F.lit(i)) for i, f in enumerate(files[1:], start=2))])


DAYS = [f"2024-01-{d:02d}" for d in range(1, 31)]


@register("c08_price_matrix", with_views(["prices"], "SELECT ticker, " + ", ".join(
    f"round(max(close) FILTER (WHERE date = DATE '{d}'), 6) AS d_{d.replace('-', '_')}" for d in DAYS)
    + " FROM prices GROUP BY ticker"))
def c08(t):
    """Long prices -> ticker × date matrix (export form); the date list is read from the data."""
    days = [r[0].isoformat() for r in t.prices.select("date").distinct().orderBy("date").collect()]
    names = [f"d_{d.replace('-', '_')}" for d in days]
    px = t.prices.withColumn("date", F.col("date").cast("string"))
    return P.pivot_items(px, ["ticker"], "date", "close", days, names)


@register("c09_set_difference", with_views(["prices"], """
SELECT DISTINCT ticker FROM prices
EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"""))
def c09(t):
    """Tickers minus an exclusion list (set difference)."""
    excl = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("ticker"))
    return t.tickers.join(excl, "ticker", "left_anti")


# ---- d: joins ---------------------------------------------------------------------------
@register("d01_full_outer", with_views(["panel", "statements"], """
SELECT coalesce(p.company, w.company) AS company, coalesce(p.date, w.date) AS date,
       round(p.market_cap, 6) AS orders_value, round(w.revenue, 6) AS revenue
FROM panel p FULL OUTER JOIN wide w ON p.company = w.company AND p.date = w.date""", STMT_CTES))
def d01(t):
    """Full outer join of the order panel and the statement panel on (company, date)."""
    p = t.panel("nation").select("company", "date", F.col("market_cap").alias("orders_value"))
    w = C.wide_statements(t.statements).select("company", "date", "revenue")
    return p.join(w, ["company", "date"], "full").select("company", "date", "orders_value", "revenue")


def macro_sql():
    return f"""SELECT date, {', '.join(c for _, c in REGION_COLS)}, crisis_dummy FROM (
  SELECT date, {', '.join(f"max(value) FILTER (WHERE series = '{s}') AS {c}" for s, c in REGION_COLS)},
         CASE WHEN date BETWEEN DATE '1997-06-30' AND DATE '1998-12-31' THEN 1 ELSE 0 END AS crisis_dummy
  FROM mff WHERE month(date) IN (3, 6, 9, 12) GROUP BY date)
WHERE {' AND '.join(f'{c} IS NOT NULL' for _, c in REGION_COLS)}"""


MACRO_CTES = [
    ("mm", MONTHLY),
    ("msp", """SELECT s.series, last_day(b.lo + to_months(CAST(i AS INTEGER))) AS date
               FROM (SELECT DISTINCT series FROM mm) s,
                    (SELECT min(date) AS lo, max(date) AS hi FROM mm) b,
                    range(0, date_diff('month', b.lo, b.hi) + 1) r(i)"""),
    ("ml", """SELECT series, date, CASE WHEN series = 'AMERICA'
                     THEN lead(value) OVER (PARTITION BY series ORDER BY date) ELSE value END AS value
              FROM msp LEFT JOIN mm USING (series, date)"""),
    ("mff", f"""SELECT series, date, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY date {RUNNING}) AS value
                FROM ml"""),
]


def macro_wide(t):
    names, cols = region_series(t)
    return C.quarterly_macro(t.macro_obs, names, cols)


@register("j04_quarterly_macro", with_views(["macro_obs"], f"""
SELECT date, {r6([c for _, c in REGION_COLS])}, crisis_dummy FROM ({macro_sql()})""", MACRO_CTES))
def j04(t):
    """Quarterly macro panel: resample, reindex, lead, forward fill, quarter ends, align, dummy."""
    return macro_wide(t)


@register("d02_panel_macro_join", with_views(["panel", "macro_obs"], f"""
SELECT p.company, p.date, round(p.market_cap, 6) AS market_cap, {', '.join(f'round(m.{c}, 6) AS {c}' for _, c in REGION_COLS)}
FROM panel p JOIN ({macro_sql()}) m ON p.date = m.date""", MACRO_CTES))
def d02(t):
    """Company panel ⋈ macro panel on date (macro side is one row per period: broadcast)."""
    p = t.panel("nation").select("company", "date", "market_cap")
    m = macro_wide(t).drop("crisis_dummy")
    return p.join(F.broadcast(m), "date").select("company", "date", "market_cap", *[c for _, c in REGION_COLS])


@register("d03_predictions_actuals", with_views(["panel_customer"], """
SELECT a.company, a.date, round(p.pred, 6) AS pred,
       round(p.pred / nullif(a.shares, 0), 6) AS pred_share_price,
       round(a.market_cap / nullif(a.shares, 0), 6) AS act_share_price
FROM panel_customer a JOIN (
  SELECT company, date, lag(market_cap) OVER (PARTITION BY company ORDER BY date) AS pred FROM panel_customer) p
ON a.company = p.company AND a.date = p.date"""))
def d03(t):
    """Predictions ⋈ actuals on (company, date), per-share prices from both."""
    a = t.panel("customer")
    preds = ts.lag_by(a.select("company", "date", "market_cap"), "company", "date", "market_cap", 1, "pred").drop("market_cap")
    j = a.join(preds, ["company", "date"])
    return j.select("company", "date", "pred", safe_div(F.col("pred"), F.col("shares")).alias("pred_share_price"),
                    safe_div(F.col("market_cap"), F.col("shares")).alias("act_share_price"))


@register("d07_anti_join", with_views(["statements"], """
SELECT company, sheet, item, period, round(value, 6) AS value FROM statements
WHERE company NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA')"""))
def d07(t):
    """Drop the companies listed in another table (left anti join)."""
    drop = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .where(F.col("r_name") == "AFRICA").select(F.col("n_nationkey").cast("bigint").alias("company")))
    return t.statements.join(drop, "company", "left_anti")


# ---- e: aggregations ----------------------------------------------------------------------
CORR_COLS = ["market_cap", "shares", "avg_order", "max_order", "urgent", "filled_share"]


def corr_sql():
    pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]
    parts = []
    for a, b in pairs:
        parts.append(f"""SELECT '{a}' AS a, '{b}' AS b,
          round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS r
          FROM (SELECT CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END::DOUBLE AS x,
                       CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END::DOUBLE AS y FROM panel_customer)""")
    return "\nUNION ALL ".join(parts)


def corr_df(t):
    p = t.panel("customer").select("company", *[F.col(c).cast("double").alias(c) for c in CORR_COLS])
    return P.correlation_pairs(p, CORR_COLS)


@register("e01_correlation_matrix", with_views(["panel_customer"], corr_sql()))
def e01(t):
    """Pearson r of every measure pair in one aggregate (NULL for constants)."""
    return corr_df(t)


@register("e02_correlated_pairs", with_views(["panel_customer"], f"SELECT * FROM ({corr_sql()}) WHERE abs(r) > 0.75"))
def e02(t):
    """Pairs with |r| > 0.75."""
    return P.correlated_pairs(corr_df(t), 0.75)


def drop_list_sql() -> str:
    """The greedy walk column by column: each one's verdict joins the survivors so far."""
    ctes = ["strong AS (SELECT a, b FROM (" + corr_sql() + ") WHERE abs(r) > 0.75)", "s0 AS (SELECT CAST([] AS VARCHAR[]) AS kept)"]
    for i, c in enumerate(CORR_COLS):
        ctes.append(f"""s{i + 1} AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM strong WHERE (b = '{c}' AND list_contains(s{i}.kept, a))
                        OR (a = '{c}' AND list_contains(s{i}.kept, b))) THEN s{i}.kept ELSE list_append(s{i}.kept, '{c}') END AS kept FROM s{i})""")
    cols = ", ".join(f"'{c}'" for c in CORR_COLS)
    return f"""SELECT name AS "column" FROM (WITH {', '.join(ctes)}
        SELECT u.name, s.kept FROM (SELECT unnest([{cols}]) AS name) u, s{len(CORR_COLS)} s) WHERE NOT list_contains(kept, name)"""


@register("e02_drop_list", with_views(["panel_customer"], drop_list_sql()))
def e02_drop(t):
    """Columns to drop: in column order, each one that correlates with an earlier survivor."""
    return P.correlated_drop_list(corr_df(t), CORR_COLS, 0.75)


QEDGES = "(SELECT quantile_cont(market_cap, [0.25, 0.5, 0.75]) AS e FROM panel)"


@register("e09_quartile_label", with_views(["panel"], f"""
SELECT company, date, CASE WHEN market_cap <= q.e[1] THEN 'Q1' WHEN market_cap <= q.e[2] THEN 'Q2'
                           WHEN market_cap <= q.e[3] THEN 'Q3' ELSE 'Q4' END AS quartile
FROM panel, {QEDGES} q"""))
def e09(t):
    """Quartile of each panel row's market cap (interpolated edges, right-closed)."""
    return P.quartile_label(t.panel("nation"), "market_cap").select("company", "date", "quartile")


@register("e09_quartile_edges", with_views(["panel"], f"""
SELECT round(e[1], 6) AS e1, round(e[2], 6) AS e2, round(e[3], 6) AS e3 FROM {QEDGES}"""))
def e09_edges(t):
    """The three interpolated quartile edges."""
    return P.quartile_edges(t.panel("nation"), "market_cap")


@register("i03_quartile_dummies", with_views(["panel"], f"""
SELECT company, date,
  CASE WHEN market_cap > q.e[1] AND market_cap <= q.e[2] THEN 1 ELSE 0 END AS quartile_q2,
  CASE WHEN market_cap > q.e[2] AND market_cap <= q.e[3] THEN 1 ELSE 0 END AS quartile_q3,
  CASE WHEN market_cap > q.e[3] THEN 1 ELSE 0 END AS quartile_q4
FROM panel, {QEDGES} q"""))
def i03(t):
    """Quartile dummies Q2..Q4 (Q1 dropped)."""
    p = t.panel("nation").select("company", "date", "market_cap")
    return P.quartile_dummies(p, "market_cap", "quartile_").drop("market_cap")


@register("e10_distinct_keys", with_views(["prices"], "SELECT DISTINCT ticker FROM prices"))
def e10(t):
    """Distinct tickers."""
    return t.tickers


@register("e12_group_means", with_views(["panel_customer"], f"""
SELECT company, {', '.join(f'{rnd(rnd(f"avg({c})", 9))} AS {c}' for c in PANEL_MEASURES)} FROM panel_customer GROUP BY company"""))
def e12(t):
    """Per-company means of the measures (pre-rounded to 9 digits: summation-order noise)."""
    m = P.group_means(t.panel("customer"), "company", PANEL_MEASURES)
    return m.select("company", *[F.round(c, 9).alias(c) for c in PANEL_MEASURES])


@register("e13_last_per_column", with_views(["panel_customer"], f"""
SELECT company, round(max_by(market_cap, date) FILTER (WHERE market_cap IS NOT NULL), 6) AS market_cap,
       max_by(shares, date) FILTER (WHERE shares IS NOT NULL) AS shares,
       max_by(urgent, date) FILTER (WHERE urgent IS NOT NULL) AS urgent
FROM ({D10_SQL}) GROUP BY company"""))
def e13(t):
    """Last non-null value of each column per company."""
    return P.last_per_column(reindexed(t), "company", "date", ["market_cap", "shares", "urgent"])


# ---- j03 ------------------------------------------------------------------------------------
J03_CTES = STMT_CTES + MACRO_CTES + [
    ("w1", "SELECT * FROM wide WHERE market_cap IS DISTINCT FROM 0"),
    ("w2", "SELECT * FROM w1 WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in ["company", "date"] + C.PANEL_NAMES)),
    ("w3", "SELECT *, lead(market_cap) OVER (PARTITION BY company ORDER BY date) AS market_cap_forecast FROM w2"),
    ("mh", f"""SELECT last_day(date - INTERVAL 6 MONTH) AS date, {', '.join(c for _, c in REGION_COLS)}, crisis_dummy
               FROM ({macro_sql()}) WHERE month(date) IN (6, 12)"""),
    ("w4", """SELECT w3.*, mh.* EXCLUDE (date),
                     CASE WHEN w3.date BETWEEN DATE '1997-06-30' AND DATE '1998-12-31' THEN 1 ELSE 0 END AS gfc_recession
              FROM w3 JOIN mh ON w3.date = mh.date"""),
    ("q", "SELECT quantile_cont(market_cap, [0.25, 0.5, 0.75]) AS e FROM w4"),
    ("w5", """SELECT w4.*,
                CASE WHEN market_cap > q.e[1] AND market_cap <= q.e[2] THEN 1 ELSE 0 END AS quartile_q2,
                CASE WHEN market_cap > q.e[2] AND market_cap <= q.e[3] THEN 1 ELSE 0 END AS quartile_q3,
                CASE WHEN market_cap > q.e[3] THEN 1 ELSE 0 END AS quartile_q4,
                max(market_cap) OVER (PARTITION BY company) - market_cap AS change_ath,
                lag(market_cap) OVER (PARTITION BY company ORDER BY date) AS market_cap_lag
              FROM w4, q"""),
    ("daily", """SELECT CAST(c_nationkey AS BIGINT) AS company, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS close
                 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""),
    ("rs", f"""SELECT company, day, stddev_samp(ret) OVER (PARTITION BY company ORDER BY day {RUNNING}) AS rolling_std
               FROM (SELECT company, day, close / lag(close) OVER (PARTITION BY company ORDER BY day) - 1 AS ret FROM daily)"""),
    ("w6", """SELECT w5.*, rs.rolling_std FROM w5 ASOF LEFT JOIN rs ON w5.company = rs.company AND w5.date >= rs.day"""),
    ("w7", """SELECT *, market_cap / lag(market_cap) OVER (PARTITION BY company ORDER BY date) - 1 AS market_cap_change
              FROM w6 WHERE rolling_std IS NOT NULL"""),
]
J03_DOUBLES = C.PANEL_NAMES + ["market_cap_forecast"] + [c for _, c in REGION_COLS] + \
    ["change_ath", "market_cap_lag", "rolling_std", "market_cap_change"]


@register("j03_model_panel", with_views(["statements", "macro_obs"], f"""
SELECT company, date, {r6(J03_DOUBLES)}, crisis_dummy, gfc_recession, quartile_q2, quartile_q3, quartile_q4
FROM w7""", J03_CTES))
def j03(t):
    """Model-ready company panel from statements, macro series and daily values."""
    daily = C.company_daily(t.orders, t.customer)
    return C.model_panel(t.statements, macro_wide(t), daily)


@register("g07_total_sort", with_views(["statements"], """
SELECT period, company, sheet, item, round(value, 6) AS value FROM statements"""))
def g07(t):
    """Statements totally ordered by (period, company, sheet, item) — a range-partitioned sort, for sinks."""
    return t.statements.orderBy("period", "company", "sheet", "item").select("period", "company", "sheet", "item", "value")
