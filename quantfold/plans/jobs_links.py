"""Registered link jobs: a12, g03, g04, e11, h14, h15, h16, h17."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links as L
from .registry import register

def _re2(pattern: str) -> str:
    """The pattern without possessive marks (DuckDB's engine is linear anyway), quoted for SQL."""
    return pattern.replace("++", "+").replace("*+", "*").replace("'", "''")


def _decoded(x: str) -> str:
    for reference, sign in L.REFERENCES:
        x = f"replace({x}, '{reference}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return x


SQL_LINKS = f"""SELECT source_id, base, CAST(row_number() OVER (PARTITION BY source_id ORDER BY i) - 1 AS INTEGER) AS pos, href, text FROM (
  SELECT source_id, base, i, text, {_decoded("CASE WHEN raw[1] IN ('\"', '''') THEN raw[2:length(raw) - 1] ELSE raw END")} AS href FROM (
    SELECT source_id, base, i, regexp_replace(regexp_extract(piece, '{_re2(L.CONTENT)}', 2), '<[^>]*>', '', 'g') AS text,
           regexp_extract_all(attrs, '{_re2(L.ATTRIBUTE)}', 2)[list_position(regexp_extract_all(lower(attrs), '{_re2(L.ATTRIBUTE)}', 1), 'href')] AS raw
    FROM (SELECT *, regexp_extract(piece, '{_re2(L.ATTRIBUTES)}', 1) AS attrs FROM (
      SELECT page_id AS source_id, url AS base, unnest(pieces[2:]) AS piece, unnest(range(len(pieces) - 1)) AS i FROM (
        SELECT page_id, url, string_split(regexp_replace(regexp_replace(html, '{_re2(L.NOISE)}', '', 'g'),
               '{_re2(L.A_TAG)}', chr(1) || '\\1', 'g'), chr(1)) AS pieces FROM pages))))
  WHERE raw IS NOT NULL)"""


def sql_abs(h: str, b: str) -> str:
    origin = f"regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    scheme = f"regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
    dirpath = f"regexp_extract({b}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*/)?', 1)"
    return f"""CASE WHEN {h} = '' THEN {b}
      WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {h}
      WHEN starts_with({h}, '//') THEN {scheme} || ':' || {h}
      WHEN starts_with({h}, '/') THEN {origin} || {h}
      WHEN starts_with({h}, '?') THEN regexp_extract({b}, '^([^?#]*)', 1) || {h}
      WHEN starts_with({h}, '#') THEN regexp_extract({b}, '^([^#]*)', 1) || {h}
      ELSE {origin} || CASE WHEN {dirpath} = '' THEN '/' ELSE {dirpath} END || {h} END"""


def links_abs(t):
    l = L.extract_links(t.pages)
    return l.select("source_id", "pos", L.absolute_url("href", "base").alias("url"))


@register("a12_extract_links", f"SELECT source_id, pos, href FROM ({SQL_LINKS})")
def a12(t):
    """Every href of every stored page with its document position."""
    return L.extract_links(t.pages).select("source_id", "pos", "href")


@register("g03_first_k_links", f"SELECT source_id, pos, href FROM ({SQL_LINKS}) WHERE pos < 4")
def g03(t):
    """First 4 links of each page in document order (an array slice: no shuffle)."""
    return L.extract_links(t.pages, k=4).select("source_id", "pos", "href")


@register("h14_absolute_url", f"SELECT source_id, pos, {sql_abs('href', 'base')} AS url FROM ({SQL_LINKS})")
def h14(t):
    """Relative links resolved against their page URL."""
    return links_abs(t)


@register("h15_url_predicates", f"""
SELECT source_id, pos, starts_with(url, 'http') AS is_http, NOT contains(url, 'google.com') AS off_search_domain,
       regexp_matches(url, '.+\\.pdf') AS is_pdf
FROM (SELECT source_id, pos, {sql_abs('href', 'base')} AS url FROM ({SQL_LINKS}))""")
def h15(t):
    """Harvest predicates per absolute link."""
    l = links_abs(t)
    return l.select("source_id", "pos", *[c.alias(n) for n, c in L.url_flags("url").items()])


@register("h16_first_year", """
SELECT page_id, regexp_extract(url || ' ' || html, '([0-9]{4})', 1) AS year FROM pages""")
def h16(t):
    """First four-digit run in the page URL + HTML ('' when none)."""
    return t.pages.select("page_id", L.first_year(F.concat_ws(" ", "url", "html")).alias("year"))


G04_WORDS = ["the"]
#: The stored pages hold no PDF links, so any path qualifies here; the operator's default is ``.+\\.pdf``.
G04_PATTERN = "/[a-z]+"


def sql_fits(url: str) -> str:
    return " AND ".join([f"regexp_matches({url}, '{G04_PATTERN}')",
                         *(f"regexp_matches({url}, '(?i)(^|[^\\p{{L}}]){w}')" for w in G04_WORDS)])


SQL_URLS = f"(SELECT source_id, pos, text, {sql_abs('href', 'base')} AS url FROM ({SQL_LINKS}))"


@register("g04_best_link", f"""
SELECT source_id, arg_max(url, (regexp_extract(url, '([0-9]{{4}})', 1), -pos)) AS url
FROM {SQL_URLS} WHERE {sql_fits('url')} GROUP BY source_id""")
def g04(t):
    """Per page the newest-year link that matches and whose title form has every word (no year last, then DOM order)."""
    return L.best_link(t.pages, G04_WORDS, G04_PATTERN)


@register("e11_hits_per_source", f"""
SELECT page_id AS source_id, CAST(coalesce(found, 0) AS INTEGER) AS found FROM pages LEFT JOIN (
  SELECT source_id, max(CASE WHEN {sql_fits('url')} THEN 1 ELSE 0 END) AS found FROM {SQL_URLS} GROUP BY source_id) ON source_id = page_id""")
def e11(t):
    """0/1 per page: does any link qualify; pages without links count as 0."""
    return L.hits_per_source(t.pages, G04_WORDS, G04_PATTERN)


@register("a12_filtered_links", f"""
SELECT source_id, pos, href, text FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS rn FROM ({SQL_LINKS})
  WHERE regexp_matches(href, '^/[A-Z]') AND contains(href, 'h') AND NOT contains(href, '.')) WHERE rn <= 3""")
def a12_filtered(t):
    """First 3 links per page whose href matches a pattern, holds a substring and lacks another."""
    return L.extract_links(t.pages, "^/[A-Z]", must=["h"], must_not=["."], k=3).select("source_id", "pos", "href", "text")


@register("h17_headline_links", f"""
SELECT source_id, pos, href AS link, text AS headline FROM ({SQL_LINKS}) WHERE contains(text, 'the')""")
def h17(t):
    """(headline, link) pairs whose headline contains a phrase."""
    a = L.extract_anchors(t.pages)
    return a.where(F.col("headline").contains("the"))
