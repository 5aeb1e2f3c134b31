"""Link harvesting from stored pages (a12, g03, g04, e11, h14–h17).

Pages arrive as rows (page_id, url, html). ``anchors`` reads the ``a`` tags of
a page in column expressions: comments, scripts and styles go, the rest is
cut at the tags, and each tag's attributes are read in any order with double,
single or no quotes. Everything per source (filters, first k, best report,
found or not) happens in arrays on the page's own row: no shuffle, no window
over one possibly huge page. ``page_id`` is unique; rows that repeat one are
pages of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import as_col
from ..functions.text import has_all_words_at_word_start

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_WS = r"[ \t\n\r\f]"
#: What holds no links, and the sign that takes the place of a tag's start.
NOISE = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|\x01"
A_TAG = r"(?i)<a([ \t\n\r\f/>])"
#: The attributes up to the end of the tag; possessive, so that an open quote costs one pass.
ATTRIBUTES = r"""(?is)^((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>"""
ATTRIBUTE = r"""([^ \t\n\r\f=/>"']++)[ \t\n\r\f]*+=[ \t\n\r\f]*+("[^"]*+"|'[^']*+'|[^ \t\n\r\f"'>]++)"""
CONTENT = ATTRIBUTES + rf"(.*?)(?:</a{_WS}*>|\z)"
#: Character references decoded in links, the ampersand last.
REFERENCES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _href(piece: Column) -> Column:
    inside = F.regexp_extract(piece, ATTRIBUTES, 1)
    values = F.zip_with(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), 1), F.regexp_extract_all(inside, F.lit(ATTRIBUTE), 2),
                        lambda name, value: F.when(F.lower(name) == "href", value))
    raw = F.get(F.array_compact(values), 0)
    link = F.when(F.left(raw, F.lit(1)).isin('"', "'"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    for reference, sign in REFERENCES:
        link = F.replace(link, F.lit(reference), F.lit(sign))
    return link


def anchors(html) -> Column:
    """array<struct<pos, href, text>> of the page's ``a`` tags with an href, in document order.

    ``text`` is the content up to ``</a>`` without inner tags. A tag that is
    never closed has no attributes; NULL html gives NULL.
    """
    marked = F.regexp_replace(F.regexp_replace(as_col(html), NOISE, ""), A_TAG, "\u0001$1")
    pieces = F.slice(F.split(marked, "\u0001"), 2, 1 << 30)
    parsed = F.transform(pieces, lambda p: F.struct(
        _href(p).alias("href"), F.regexp_replace(F.regexp_extract(p, CONTENT, 2), r"<[^>]*>", "").alias("text")))
    linked = F.filter(parsed, lambda x: x["href"].isNotNull())
    return F.transform(linked, lambda x, i: F.struct(i.alias("pos"), x["href"].alias("href"), x["text"].alias("text")))


def _wanted(url: Column, pattern: str | None, must: Sequence[str], must_not: Sequence[str]) -> Column:
    ok = F.lit(True) if pattern is None else url.rlike(pattern)
    for part in must:
        ok = ok & url.contains(part)
    for part in must_not:
        ok = ok & ~url.contains(part)
    return ok


def page_links(pages: DataFrame, pattern: str | None = None, must: Sequence[str] = (), must_not: Sequence[str] = (),
               k: int | None = None, id_col: str = "page_id", html_col: str = "html", base_col: str = "url") -> DataFrame:
    """(source_id, base, links): a page's links that match, the first ``k`` of them.

    ``pattern`` is a regular expression and ``must`` / ``must_not`` are
    substrings of the href. A page without links keeps its row, with an empty array.
    """
    # the array is made in a row of its own step, so a filter does not repeat the parsing
    found = pages.select(F.col(id_col).alias("source_id"), F.col(base_col).alias("base"), anchors(html_col).alias("links"))
    links = F.filter("links", lambda x: _wanted(x["href"], pattern, must, must_not))
    links = F.coalesce(links if k is None else F.slice(links, 1, k), F.array().cast("array<struct<pos:int,href:string,text:string>>"))
    return found.select("source_id", "base", links.alias("links"))


def extract_links(pages: DataFrame, pattern: str | None = None, must: Sequence[str] = (), must_not: Sequence[str] = (),
                  k: int | None = None, **cols) -> DataFrame:
    """a12 (+g03 when ``k``): (source_id, base, pos, href, text), a row a link in document order."""
    rows = page_links(pages, pattern, must, must_not, k, **cols)
    return rows.select("source_id", "base", F.explode("links").alias("l")).select("source_id", "base", "l.pos", "l.href", "l.text")


def extract_anchors(pages: DataFrame, **cols) -> DataFrame:
    """(source_id, pos, link, headline) of every link."""
    return extract_links(pages, **cols).select("source_id", "pos", F.col("href").alias("link"), F.col("text").alias("headline"))


def absolute_url(href, base) -> Column:
    """h14: resolve ``href`` against ``base`` (scheme-, host- and path-relative forms).

    Dot segments ('..', '.') are kept as written.
    """
    h, b = as_col(href), as_col(base)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    dirpath = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*/)?", 1)
    no_query = F.regexp_extract(b, r"^([^?#]*)", 1)
    no_frag = F.regexp_extract(b, r"^([^#]*)", 1)
    return (F.when(h == "", b)
             .when(h.rlike(SCHEME), h)
             .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
             .when(h.startswith("/"), F.concat(origin, h))
             .when(h.startswith("?"), F.concat(no_query, h))
             .when(h.startswith("#"), F.concat(no_frag, h))
             .otherwise(F.concat(origin, F.when(dirpath == "", F.lit("/")).otherwise(dirpath), h)))


def url_flags(url) -> dict[str, Column]:
    """h15: the link predicates used when harvesting."""
    u = as_col(url)
    return {"is_http": u.startswith("http"),
            "off_search_domain": ~u.contains("google.com"),
            "is_pdf": u.rlike(r".+\.pdf")}


def first_year(url) -> Column:
    """h16: first run of four digits, '' when there is none."""
    return F.regexp_extract(as_col(url), r"(\d{4})", 1)


def _candidates(words: Sequence[str], pattern: str | None) -> Callable[[Column], Column]:
    def ok(url: Column) -> Column:
        named = has_all_words_at_word_start(url, words)
        return named if pattern is None else named & url.rlike(pattern)
    return ok


def best_link(pages: DataFrame, words: Sequence[str], pattern: str | None = r".+\.pdf", **cols) -> DataFrame:
    """g04: per page the newest-year link (no year last, then document order) that matches
    ``pattern`` and whose title-cased absolute form holds every word at a word start.

    Pages without such a link have no row (the found-only reduction of e11).
    """
    ok = _candidates(words, pattern)
    urls = F.transform("links", lambda x: F.struct(x["pos"].alias("pos"), absolute_url(x["href"], F.col("base")).alias("url")))
    fit = F.filter(F.col("urls"), lambda x: ok(x["url"]))
    best = F.array_max(F.transform(fit, lambda x: F.struct(first_year(x["url"]).alias("y"), (-x["pos"]).alias("p"), x["url"].alias("url"))))
    rows = page_links(pages, **cols).select("source_id", "base", urls.alias("urls")).select("source_id", best.alias("best"))
    return rows.where("best IS NOT NULL").select("source_id", "best.url")


def hits_per_source(pages: DataFrame, words: Sequence[str], pattern: str | None = None, **cols) -> DataFrame:
    """e11: 1 or 0 per page — does any of its links qualify; a page without links has 0."""
    ok = _candidates(words, pattern)
    found = F.exists("links", lambda x: ok(absolute_url(x["href"], F.col("base"))))
    return page_links(pages, **cols).select("source_id", F.coalesce(found, F.lit(False)).cast("int").alias("found"))
