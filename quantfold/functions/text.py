"""Text column expressions (all JVM-side regex / string / array functions).

Whitespace is an explicit ASCII class rather than ``\\s`` so that Java
(Spark) and RE2 (the SQL oracle) agree byte for byte; NBSP is mapped to a
space first, as the page cleaner does.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

WS = r"[ \t\n\x0B\f\r]"
NON_WS = r"[^ \t\n\x0B\f\r]"
TOKEN = r"[\p{L}\p{N}_]{2,}"

# Spark's default English stop-word list
# (pyspark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")), in its own order.
STOP_WORDS = tuple("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of at by
for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd
she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't
haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
how's let's ought that's there's what's when's where's who's why's would""".split())

# Ordered literal replacements for text-extraction damage, applied in this order.
REPLACEMENTS = (
    ("in ation", "inflation"),
    ("nancial", "financial"),
    ("signi cant", "significant"),
    ("con dence", "confidence"),
    ("speci c", "specific"),
    ("andor ", "and/or"),
    ("fifinancial", "financial"),
    ("scal", "scale"),
    ("covidrelated", "covid related"),
    ("and/orinvestment", "and/or investment"),
)

# Words removed from the policy-vocabulary lexicon as not economic.
REMOVE_WORDS = ("members", "market", "year", "quarter", "months", "time", "period", "levels", "term", "year",
                "level", "p", "meeting", "support", "c", "end", "firms", "discussion", "pace", "d-19", "liason",
                "bank", "authorities", "loan", "half", "work", "payments", "u", "part", "information", "system",
                "cities", "headline", "line", "asset", "point", "approvals", "g", "hours", "survey", "quarters",
                "extend", "depreciation", "parts", "state", "v", "people", "owner", "rents", "intentions")

# Keywords whose sentences (and the sentence after) are extracted.
KEYWORDS = ("economic risk", "business risk", "outlook", "economic condition", "headwind",
            "macroeconomic", "pressure", "trends")


# Characters that clean_page keeps, each named singly: Java looks such a class up in a table,
# while it tries the ranges of [a-zA-Z0-9...] one after the other (eight times slower).
PAGE_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.," + r" \t\n\x0B\f\r"


def clean_page(c) -> Column:
    """h01: newline/NBSP -> space, drop URLs, keep [a-zA-Z whitespace . , 0-9], lower, collapse, trim.

    URL removal and the character filter run as one alternation: scanning
    the original text left to right, a position either starts a URL (removed
    whole) or holds a disallowed character (removed) — the same result as
    the two passes in sequence, in one pass.
    """
    t = F.replace(F.replace(as_col(c), F.lit("\n"), F.lit(" ")), F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(t, rf"http{NON_WS}+|[^{PAGE_CHARS}]+", "")
    t = F.lower(t)  # ASCII only by now: the fast path
    # single spaces stay as they are
    return F.trim(F.regexp_replace(t, rf"{WS}{{2,}}|[\t\n\x0B\f\r]", " "))


# The minutes-cleaning patterns, applied in this order.
MINUTES_STRIP = rf"(@\[A-Za-z0-9]+)|([^0-9A-Za-z \t])|(\w+:\/\/{NON_WS}+)|^r|"
CAPITAL_SPLIT = rf"(?<!{WS})(?=[A-Z])"


def clean_minutes(c) -> Column:
    """h02: strip handles, symbols, URLs and a leading 'r'; tabs -> space; space before capitals; collapse."""
    t = F.regexp_replace(as_col(c), MINUTES_STRIP, "")
    t = F.regexp_replace(t, r"\t", " ")
    t = F.regexp_replace(t, CAPITAL_SPLIT, " ")
    return F.regexp_replace(t, f"{WS}+", " ")


def between_markers(c, start: str, end: str) -> Column:
    """h03: text from the start marker up to (not incl.) the end marker; NULL if either is missing."""
    c = as_col(c)
    s, e = F.instr(c, start), F.instr(c, end)
    return (F.when((s == 0) | (e == 0), F.lit(None))
             .when(e <= s, F.lit(""))
             .otherwise(F.substring(c, s, e - s)))


def remove_stop_words(c, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """h04: drop whitespace-separated tokens whose lower case is a stop word."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    toks = F.filter(F.split(as_col(c), f"{WS}+"), lambda t: (F.length(t) > 0) & ~F.array_contains(stop, F.lower(t)))
    return F.array_join(toks, " ")


def digit_count(c) -> Column:
    """h05: number of decimal digits."""
    return F.regexp_count(as_col(c), F.lit("[0-9]")).cast("bigint")


def substring_count(c, word) -> Column:
    """Non-overlapping occurrences of ``word`` (Python ``str.count``)."""
    c, w = as_col(c), as_col(word) if not isinstance(word, str) else F.lit(word)
    return F.try_divide(F.length(c) - F.length(F.replace(c, w, F.lit(""))), F.length(w)).cast("bigint")


def lexicon_hits(c, words: Sequence[str]) -> Column:
    """h06: Σ over a bounded word list of non-overlapping substring counts.

    Each text is scanned once per word by ``str.count`` inside an
    Arrow-batched pandas UDF (the JVM form — 200 ``replace`` calls per row —
    is several times slower). The list is a top-k result, so it is small.
    """
    lex = tuple(words)

    @F.pandas_udf("bigint")
    def _hits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else sum(t.count(w) for w in lex))

    return _hits(as_col(c))


def lexicon_hits_expr(c, words: Sequence[str]) -> Column:
    """JVM-only form of ``lexicon_hits`` (a flat sum of per-word counts)."""
    c = as_col(c)
    total = F.lit(0).cast("bigint")
    for w in words:
        total = total + F.coalesce(substring_count(c, w), F.lit(0).cast("bigint"))
    return total


def replace_chain(c, pairs: Sequence[tuple[str, str]] = REPLACEMENTS) -> Column:
    """h07: ordered literal replacements (order is part of the result)."""
    out = as_col(c)
    for a, b in pairs:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def split_sentences(c) -> Column:
    """h08: sentence pieces split on '. '."""
    return F.split(as_col(c), r"\. ")


def tokens(c) -> Column:
    """Word tokens of two or more letters/digits, lower-cased (TF-IDF tokenizer)."""
    return F.regexp_extract_all(F.lower(as_col(c)), F.lit(f"({TOKEN})"), 1)


def keyword_sentences(arr, keywords: Sequence[str] = KEYWORDS) -> Column:
    """h09: for each keyword in order, every sentence containing it plus the next one, space-joined.

    ``arr`` is the sentence array column (``split_sentences``), materialised
    by the caller in an earlier projection so it is split once per text.
    """
    arr = as_col(arr)
    n = F.size(arr)

    def per_kw(k):
        idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        picked = F.transform(idx, lambda i: F.when(
            (i <= n) & F.contains(F.element_at(arr, i), F.lit(k)),
            F.when(i < n, F.array(F.element_at(arr, i), F.element_at(arr, i + 1)))
             .otherwise(F.array(F.element_at(arr, i)))).otherwise(F.array().cast("array<string>")))
        return F.flatten(picked)

    return F.array_join(F.flatten(F.array(*[per_kw(k) for k in keywords])), " ")


def paragraphs(arr, size: int = 3) -> Column:
    """h10: consecutive blocks of ``size`` sentences, each space-joined (array per text).

    ``arr`` is the sentence array column, materialised by the caller.
    """
    arr = as_col(arr)
    nblocks = F.ceil(F.size(arr) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), nblocks - 1),
                       lambda b: F.array_join(F.slice(arr, b * size + 1, size), " "))


def has_all_words_at_word_start(c, words: Sequence[str]) -> Column:
    """True when every word occurs case-insensitively at the start of a letter run."""
    cond = None
    for w in words:
        x = as_col(c).rlike(rf"(?i)(^|[^\p{{L}}]){w}")
        cond = x if cond is None else (cond & x)
    return cond
