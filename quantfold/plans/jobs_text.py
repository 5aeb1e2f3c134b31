"""Registered text jobs: h01–h13, h18, e03, e04, f11, g01, g02, g06, b12, d04, d08, d11."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import text as X
from ..operators import timeseries as ts
from ..sources.sinks import scratch_path
from .registry import register
from .sqlviews import with_views

WS = r"[ \t\n\x0B\f\r]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


# ---- SQL forms of the column functions ------------------------------------------------
def sql_clean_page(c: str) -> str:
    t = f"translate({c}, chr(10) || chr(160), '  ')"
    t = fr"regexp_replace({t}, 'http[^ \t\n\x0B\f\r]+', '', 'g')"
    t = fr"regexp_replace({t}, '[^a-zA-Z \t\n\x0B\f\r.,0-9]', '', 'g')"
    return f"trim(regexp_replace(lower({t}), '{WS}+', ' ', 'g'))"


def sql_clean_minutes(c: str) -> str:
    t = fr"regexp_replace({c}, '(@\[A-Za-z0-9]+)|([^0-9A-Za-z \t])|(\w+:\/\/[^ \t\n\x0B\f\r]+)|^r|', '', 'g')"
    t = fr"regexp_replace({t}, '\t', ' ', 'g')"
    t = fr"regexp_replace({t}, '([A-Z])', ' \1', 'g')"
    return f"regexp_replace({t}, '{WS}+', ' ', 'g')"


def sql_stop(c: str) -> str:
    return (f"array_to_string(list_filter(string_split_regex({c}, '{WS}+'), "
            f"lambda t: length(t) > 0 AND NOT list_contains({sql_list(T.STOP_WORDS)}, lower(t))), ' ')")


def sql_digits(c: str) -> str:
    return f"CAST(length({c}) - length(regexp_replace({c}, '[0-9]', '', 'g')) AS BIGINT)"


def sql_replace_chain(c: str) -> str:
    out = c
    for a, b in T.REPLACEMENTS:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


TOKEN_RE = r"'([\p{L}\p{N}_]{2,})'"

# cleaned minutes: the comparison corpus (minutes cleaned, stop words removed)
MC = ("mc", f"SELECT doc_id, {sql_stop(sql_clean_minutes('content'))} AS content FROM minutes")
PAGES = ("pg", f"SELECT report_id, page_no, {sql_clean_page('content')} AS content FROM doc_pages")


def centroid_ctes():
    return [
        MC,
        ("ctok", f"SELECT doc_id, unnest(regexp_extract_all(lower(content), {TOKEN_RE}, 1)) AS token FROM mc"),
        ("ctf", "SELECT doc_id, token, count(*) AS tf FROM ctok GROUP BY doc_id, token"),
        ("ncorp", "SELECT count(*) AS n FROM mc"),
        ("idf", "SELECT token, count(*) AS df, ln((1 + any_value(ncorp.n)) / (1 + count(*))) + 1 AS idf FROM ctf, ncorp GROUP BY token"),
        ("cw", "SELECT doc_id, token, tf * idf AS w FROM ctf JOIN idf USING (token)"),
        ("cu", "SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM cw"),
        ("cen", "SELECT token, idf.idf, sum(cu.w) / any_value(ncorp.n) AS c FROM cu JOIN idf USING (token), ncorp GROUP BY token, idf.idf"),
    ]


def sql_scores(src: str, ids: str, txt: str) -> list[tuple[str, str]]:
    """CTEs scoring ``txt`` of table ``src`` keyed by ``ids`` -> table ``scored(ids..., score)``."""
    return [
        ("dsrc", f"SELECT {ids}, {txt} AS txt, ({txt} IS NULL OR length({txt}) = 0) AS empty FROM {src}"),
        ("dtok", f"SELECT {ids}, unnest(regexp_extract_all(lower(txt), {TOKEN_RE}, 1)) AS token FROM dsrc"),
        ("dtf", f"SELECT {ids}, token, count(*) AS tf FROM dtok GROUP BY ALL"),
        ("per", f"""SELECT {ids}, sum(tf * cen.idf * cen.c) AS dot, sqrt(sum(pow(tf * cen.idf, 2))) AS norm
                   FROM dtf JOIN cen USING (token) GROUP BY {ids}"""),
        ("scored", f"""SELECT {ids}, CASE WHEN dsrc.empty THEN NULL ELSE coalesce(per.dot / nullif(per.norm, 0), 0.0) END AS score
                      FROM dsrc LEFT JOIN per USING ({ids})"""),
    ]


def minutes_clean(t):
    """The comparison corpus: minutes cleaned (h02) with stop words removed (h04)."""
    return t.minutes.select("doc_id", T.remove_stop_words(T.clean_minutes("content")).alias("content"))


def pages_clean(t):
    return t.doc_pages.select("report_id", "page_no", T.clean_page("content").alias("content"))


# ---- h01..h07 -------------------------------------------------------------------------------
@register("h01_clean_page", with_views(["doc_pages"], f"SELECT report_id, page_no, content FROM pg", [PAGES]))
def h01(t):
    """Page text cleaned: no URLs, only letters/digits/.,/whitespace, lower case, collapsed."""
    return pages_clean(t)


@register("h02_clean_minutes", with_views(["minutes"], f"SELECT doc_id, {sql_clean_minutes('content')} AS content FROM minutes"))
def h02(t):
    """Policy-minute text cleaned: symbols, URLs, leading 'r' removed; space before capitals."""
    return t.minutes.select("doc_id", T.clean_minutes("content").alias("content"))


@register("h03_between_markers", with_views(["minutes"], """
SELECT doc_id, CASE WHEN instr(content, 'the') = 0 OR instr(content, 'and') = 0 THEN NULL
                    WHEN instr(content, 'and') <= instr(content, 'the') THEN ''
                    ELSE substring(content, instr(content, 'the'), instr(content, 'and') - instr(content, 'the')) END AS part
FROM minutes"""))
def h03(t):
    """Text between a start and an end marker (NULL when a marker is missing)."""
    return t.minutes.select("doc_id", T.between_markers("content", "the", "and").alias("part"))


@register("h04_stop_words", with_views(["minutes"], "SELECT doc_id, content FROM mc", [MC]))
def h04(t):
    """Cleaned minutes with English stop words removed (the comparison corpus)."""
    return minutes_clean(t)


@register("h05_digits_and_length", with_views(["doc_pages"], f"""
SELECT page_no, {sql_digits('content')} AS content_count, CAST(length(content) AS BIGINT) AS content_len FROM pg""", [PAGES]))
def h05(t):
    """Digit count and length of each cleaned page (also d04: derived columns, no self join)."""
    p = pages_clean(t)
    return p.select("page_no", T.digit_count("content").alias("content_count"),
                    F.length("content").cast("bigint").alias("content_len"))


def lexicon_df(t):
    return X.lexicon(minutes_clean(t), "content", 200)


LEX_CTES = [
    MC,
    ("mtok", f"SELECT unnest(list_filter(string_split_regex(lower(content), '{WS}+'), lambda x: length(x) > 0)) AS token FROM mc"),
    ("mfreq", "SELECT token, count(*) AS frequency FROM mtok GROUP BY token"),
    ("top200", "SELECT token, frequency FROM mfreq ORDER BY frequency DESC, token LIMIT 200"),
    ("lex", f"SELECT token AS word FROM top200 WHERE NOT list_contains({sql_list(T.REMOVE_WORDS)}, token)"),
]


def sql_hits(c: str) -> str:
    return (f"CAST(coalesce(list_sum(list_transform((SELECT list(word) FROM lex), "
            f"lambda w: (length({c}) - length(replace({c}, w, ''))) // length(w))), 0) AS BIGINT)")


@register("h06_lexicon_hits", with_views(["doc_pages", "minutes"], f"""
SELECT page_no, hits FROM (SELECT page_no, {sql_hits('content')} AS hits FROM pg) WHERE hits > 5""", LEX_CTES + [PAGES]))
def h06(t):
    """Σ of lexicon-word substring counts per page, pages with more than 5 hits."""
    lex = X.lexicon_words(lexicon_df(t))  # a top-200 list: bounded
    p = pages_clean(t).select("page_no", T.lexicon_hits("content", lex).alias("hits"))
    return p.where(F.col("hits") > 5)


@register("h07_replacements", with_views(["doc_pages"], f"SELECT page_no, {sql_replace_chain('content')} AS content FROM pg", [PAGES]))
def h07(t):
    """Ordered literal replacement dictionary applied to cleaned pages."""
    return pages_clean(t).select("page_no", T.replace_chain("content").alias("content"))


SENT_SQL = ("sents", r"""SELECT report_id, page_no, CAST(unnest(range(len(arr))) AS INTEGER) AS sent_no, unnest(arr) AS sentence
            FROM (SELECT report_id, page_no, string_split_regex(content, '\. ') AS arr FROM pg)""")


@register("h08_sentence_split", with_views(["doc_pages"], "SELECT report_id, page_no, sent_no, sentence FROM sents", [PAGES, SENT_SQL]))
def h08(t):
    """Pages exploded to '. '-separated sentences with their position (c07)."""
    return X.explode_sentences(pages_clean(t), "content").drop("content")


H09_KEYWORDS = ("thatin", "orantion", "rewh")


def sql_keyword_sentences(c: str, kws) -> str:
    parts = []
    for k in kws:
        parts.append(f"""flatten(list_transform(range(1, len(arr) + 1), lambda i:
            CASE WHEN contains(arr[i], {q(k)}) THEN (CASE WHEN i < len(arr) THEN [arr[i], arr[i + 1]] ELSE [arr[i]] END)
                 ELSE []::VARCHAR[] END))""")
    return f"array_to_string(flatten([{', '.join(parts)}]), ' ')"


@register("h09_keyword_sentences", with_views(["doc_pages"], fr"""
SELECT page_no, {sql_keyword_sentences('arr', H09_KEYWORDS)} AS extracted
FROM (SELECT page_no, string_split_regex(content, '\. ') AS arr FROM pg)""", [PAGES]))
def h09(t):
    """Sentences containing each keyword plus the following sentence, keyword order then position."""
    p = pages_clean(t).select("page_no", T.split_sentences("content").alias("arr"))
    return p.select("page_no", T.keyword_sentences("arr", H09_KEYWORDS).alias("extracted"))


@register("h10_paragraphs", with_views(["doc_pages"], r"""
SELECT page_no, sent_no, sentence, array_to_string(arr[(sent_no // 3) * 3 + 1:(sent_no // 3) * 3 + 3], ' ') AS paragraph
FROM (SELECT page_no, arr, CAST(unnest(range(len(arr))) AS INTEGER) AS sent_no, unnest(arr) AS sentence
      FROM (SELECT page_no, string_split_regex(content, '\. ') AS arr FROM pg))""", [PAGES]))
def h10(t):
    """Paragraph proxy: each sentence with its block of three consecutive sentences."""
    s = X.sentences_with_paragraphs(pages_clean(t), "content", 3)
    return s.select("page_no", "sent_no", "sentence", "paragraph")


@register("h11_join_resplit", with_views(["doc_pages"], r"""
SELECT page_no, md5(array_to_string(arr, ' - ')) AS joined_md5,
       CAST(len(string_split(array_to_string(arr, ' - '), ' - ')) AS INTEGER) AS pieces
FROM (SELECT page_no, string_split_regex(content, '\. ') AS arr FROM pg)""", [PAGES]))
def h11(t):
    """Sentences joined with ' - ' and split back on it."""
    j = F.array_join(T.split_sentences("content"), " - ")
    return pages_clean(t).select("page_no", F.md5(j).alias("joined_md5"),
                                 F.size(F.split(j, " - ")).alias("pieces"))


@register("f11_block_number", with_views(["doc_pages"], """
SELECT page_no, sent_no, CAST((row_number() OVER (PARTITION BY page_no ORDER BY sent_no) - 1) // 3 + 1 AS BIGINT) AS block
FROM sents""", [PAGES, SENT_SQL]))
def f11(t):
    """Blocks of three consecutive sentences per page (window form)."""
    s = X.explode_sentences(pages_clean(t), "content").select("page_no", "sent_no")
    return ts.block_number(s, "page_no", "sent_no", 3, "block")


@register("e04_ordered_concat", with_views(["doc_pages"], """
SELECT page_no, (sent_no // 3) + 1 AS block, string_agg(sentence, ' ' ORDER BY sent_no) AS paragraph
FROM sents GROUP BY page_no, (sent_no // 3) + 1""", [PAGES, SENT_SQL]))
def e04(t):
    """Ordered concatenation per (page, block): the grouped form of the paragraph proxy."""
    s = X.explode_sentences(pages_clean(t), "content").withColumn("block", (F.floor(F.col("sent_no") / 3) + 1).cast("int"))
    return X.ordered_concat(s, ["page_no", "block"], "sentence", ["sent_no"], " ", "paragraph")


# ---- tokens ----------------------------------------------------------------------------------
@register("e03_token_frequency", with_views(["minutes"], "SELECT token, frequency FROM mfreq", LEX_CTES[:3]))
def e03(t):
    """Token frequency of the cleaned minutes."""
    return X.token_frequency(minutes_clean(t), "content")


@register("g01_top_tokens", with_views(["minutes"], "SELECT token, frequency FROM top200", LEX_CTES[:4]))
def g01(t):
    """Top-200 tokens by frequency (ties by token)."""
    return X.top_tokens(X.token_frequency(minutes_clean(t), "content"), 200)


@register("d11_lexicon_semi_join", with_views(["doc_pages", "minutes"], f"""
SELECT page_no, count(*) AS lexicon_tokens FROM (
  SELECT page_no, unnest(string_split_regex(lower(content), '{WS}+')) AS token FROM pg)
WHERE token IN (SELECT word FROM lex) GROUP BY page_no""", LEX_CTES + [PAGES]))
def d11(t):
    """Page tokens semi-joined with the (≤ 200 word) policy lexicon, counted per page."""
    toks = X.token_rows(pages_clean(t), ["page_no"], "content", True, split_ws=True)
    lex = lexicon_df(t).withColumnRenamed("word", "token")
    return toks.join(F.broadcast(lex), "token", "left_semi").groupBy("page_no").agg(F.count(F.lit(1)).alias("lexicon_tokens"))


# ---- TF-IDF / similarity -------------------------------------------------------------------------
@register("h12_tfidf_idf", with_views(["minutes"], "SELECT token, df, round(idf, 6) AS idf FROM idf", centroid_ctes()))
def h12(t):
    """Smoothed idf of every corpus term: ln((1+n)/(1+df)) + 1."""
    mc = minutes_clean(t)
    counts = X.token_rows(mc, ["doc_id"], "content").groupBy("doc_id", "token").count()
    n = mc.select(F.count(F.lit(1))).scalar()
    return counts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).select(
        "token", "df", (F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + F.lit(1.0)).alias("idf"))


@register("h12_tfidf_weights", with_views(["minutes"], "SELECT doc_id, token, round(w, 6) AS w FROM cu", centroid_ctes()))
def h12_weights(t):
    """Unit (L2-normalised) TF-IDF weights of the corpus documents."""
    _, unit = X.tfidf_model(minutes_clean(t), "doc_id", "content")
    return unit


@register("h12_tfidf_apply", with_views(["doc_pages", "minutes"], """
SELECT page_no, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY page_no)), 6) AS w
FROM (SELECT page_no, token, tf * idf AS w FROM dtf JOIN idf USING (token))""",
                                       centroid_ctes() + [PAGES] + sql_scores("pg", "page_no", "content")))
def h12_apply(t):
    """The model fitted on the minutes, stored, loaded by path and applied to the report pages."""
    path = X.save_tfidf(minutes_clean(t), "doc_id", "content", scratch_path(t.spark, "tfidf"))
    return X.tfidf_transform(pages_clean(t), ["page_no"], "content", X.load_tfidf(t.spark, path))


@register("h13_similarity_pages", with_views(["doc_pages", "minutes"], "SELECT page_no, round(score, 6) AS score FROM scored",
                                             centroid_ctes() + [PAGES] + sql_scores("pg", "page_no", "content")))
def h13(t):
    """Mean cosine similarity of every cleaned page to the policy corpus (d08 without pairs)."""
    cen = X.corpus_centroid(minutes_clean(t), "doc_id", "content")
    return X.similarity_to_corpus(pages_clean(t), ["page_no"], "content", cen)


@register("h13_similarity_paragraphs", with_views(["doc_pages", "minutes"], "SELECT page_no, block, round(score, 6) AS score FROM scored",
                                                  centroid_ctes() + [PAGES] + [
    ("paras", r"""SELECT page_no, CAST(unnest(range(1, len(pa) + 1)) AS INTEGER) AS block, unnest(pa) AS paragraph FROM (
        SELECT page_no, list_transform(range(0, CAST(ceil(len(arr) / 3) AS BIGINT)), lambda b: array_to_string(arr[b * 3 + 1:b * 3 + 3], ' ')) AS pa
        FROM (SELECT page_no, string_split_regex(content, '\. ') AS arr FROM pg))""")] + sql_scores("paras", "page_no, block", "paragraph")))
def h13_paragraphs(t):
    """Mean cosine similarity of every paragraph (3-sentence block) to the corpus."""
    cen = X.corpus_centroid(minutes_clean(t), "doc_id", "content")
    p = pages_clean(t).select("page_no", T.split_sentences("content").alias("arr"))
    p = p.select("page_no", F.posexplode(T.paragraphs("arr", 3)).alias("b", "paragraph"))
    p = p.select("page_no", (F.col("b") + 1).alias("block"), "paragraph")
    return X.similarity_to_corpus(p, ["page_no", "block"], "paragraph", cen)


# ---- selection -------------------------------------------------------------------------------------
DISTINCT_SQL = ("dist", """SELECT sentence, arg_min(report_id, (report_id, page_no, sent_no)) AS report_id,
                                  arg_min(page_no, (report_id, page_no, sent_no)) AS page_no,
                                  arg_min(sent_no, (report_id, page_no, sent_no)) AS sent_no
                           FROM sents GROUP BY sentence""")


@register("g06_distinct_first", with_views(["doc_pages"], "SELECT sentence, report_id, page_no, sent_no FROM dist",
                                           [PAGES, SENT_SQL, DISTINCT_SQL]))
def g06(t):
    """Distinct sentences, each with its first (report, page, position)."""
    s = X.explode_sentences(pages_clean(t), "content")
    return X.first_by(s, "sentence", ["report_id", "page_no", "sent_no"], ["report_id", "page_no", "sent_no"])


@register("b12_numeric_filter", with_views(["doc_pages"], f"""
SELECT page_no, sent_no FROM sents WHERE {sql_digits('sentence')} < 3 AND length(sentence) > 100""", [PAGES, SENT_SQL]))
def b12(t):
    """Sentences with fewer than 3 digits and more than 100 characters."""
    s = X.explode_sentences(pages_clean(t), "content")
    return s.where((T.digit_count("sentence") < 3) & (F.length("sentence") > 100)).select("page_no", "sent_no")


@register("g02_top_share", with_views(["doc_pages", "minutes"], """
SELECT page_no, round(score, 6) AS score FROM (
  SELECT page_no, score, row_number() OVER (ORDER BY score DESC, page_no) AS rn FROM scored)
WHERE rn <= floor((SELECT count(*) FROM scored) * 0.025)""", centroid_ctes() + [PAGES] + sql_scores("pg", "page_no", "content")))
def g02(t):
    """Top 2.5 % of pages by similarity, int(n · 0.025) rows (exact order statistic, no sort)."""
    cen = X.corpus_centroid(minutes_clean(t), "doc_id", "content")
    s = X.similarity_to_corpus(pages_clean(t), ["page_no"], "content", cen)
    return X.top_fraction(s, "score", [F.col("page_no")], 0.025)


def sentence_selection(t, fraction: float = 0.025, min_hits: int = 5):
    """h18: clean → exclude → split → distinct → score → digit/length filter → top share → lexicon → replace."""
    s = X.explode_sentences(pages_clean(t), "content", skip_if_contains="notes to the")
    s = X.first_by(s, "sentence", ["report_id", "page_no", "sent_no"], ["report_id", "page_no", "sent_no"])
    s = s.where((T.digit_count("sentence") < 3) & (F.length("sentence") > 100))
    cen = X.corpus_centroid(minutes_clean(t), "doc_id", "content")
    # a distinct sentence is keyed by its first position: numeric keys, not the text
    scored = X.similarity_to_corpus(s, ["page_no", "sent_no"], "sentence", cen)
    s = s.join(scored, ["page_no", "sent_no"])
    top = X.top_fraction(s, "score", [F.col("sentence")], fraction)
    lex = X.lexicon_words(lexicon_df(t))  # a top-200 list: bounded
    top = top.where(T.lexicon_hits("sentence", lex) > min_hits)
    return top.select("report_id", "page_no", "sent_no", T.replace_chain("sentence").alias("sentence"), "score")


@register("h18_sentence_selection", with_views(["doc_pages", "minutes"], f"""
SELECT report_id, page_no, sent_no, {sql_replace_chain('sentence')} AS sentence, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, sentence) AS rn FROM (
     SELECT d.*, s.score FROM dsel d JOIN scored s USING (sentence)))
WHERE rn <= floor((SELECT count(*) FROM dsel) * 0.025) AND {sql_hits('sentence')} > 5""",
    centroid_ctes() + LEX_CTES[1:] + [
        ("pg", f"SELECT * FROM ({PAGES[1]}) WHERE NOT contains(content, 'notes to the')"), SENT_SQL, DISTINCT_SQL,
        ("dsel", f"SELECT * FROM dist WHERE {sql_digits('sentence')} < 3 AND length(sentence) > 100")]
    + sql_scores("dsel", "sentence", "sentence")))
def h18(t):
    """End-to-end selection of policy-like report sentences."""
    return sentence_selection(t)


# ---- explicit entries for operators used inside the jobs above ------------------------------------
@register("c07_explode_with_position", with_views(["minutes"], r"""
SELECT doc_id, CAST(unnest(range(len(arr))) AS INTEGER) AS pos, unnest(arr) AS piece
FROM (SELECT doc_id, string_split_regex(content, '\. ') AS arr FROM mc)""", [MC]))
def c07(t):
    """Cleaned minutes split into '. ' pieces, one row each with its position."""
    return X.explode_sentences(minutes_clean(t), "content", "piece", "pos").drop("content")


@register("d04_derived_columns", with_views(["doc_pages"], f"""
SELECT page_no, sent_no, {sql_digits('sentence')} AS sentence_count, CAST(length(sentence) AS BIGINT) AS sentence_len,
       {sql_digits('paragraph')} AS paragraph_count, CAST(length(paragraph) AS BIGINT) AS paragraph_len
FROM (SELECT page_no, sent_no, sentence, array_to_string(arr[(sent_no // 3) * 3 + 1:(sent_no // 3) * 3 + 3], ' ') AS paragraph
      FROM (SELECT page_no, arr, CAST(unnest(range(len(arr))) AS INTEGER) AS sent_no, unnest(arr) AS sentence
            FROM (SELECT page_no, string_split_regex(content, '\\. ') AS arr FROM pg)))""", [PAGES]))
def d04(t):
    """Digit counts and lengths of sentence and paragraph columns added with ``select`` (no self joins)."""
    s = X.sentences_with_paragraphs(pages_clean(t), "content", 3)
    return s.select("page_no", "sent_no",
                    T.digit_count("sentence").alias("sentence_count"), F.length("sentence").cast("bigint").alias("sentence_len"),
                    T.digit_count("paragraph").alias("paragraph_count"), F.length("paragraph").cast("bigint").alias("paragraph_len"))


@register("d08_corpus_mean_cosine", with_views(["minutes"], "SELECT doc_id, round(score, 6) AS score FROM scored",
                                               centroid_ctes() + sql_scores("mc", "doc_id", "content")))
def d08(t):
    """Mean cosine of every corpus document to all corpus documents — no document pairs formed."""
    mc = minutes_clean(t)
    return X.similarity_to_corpus(mc, ["doc_id"], "content", X.corpus_centroid(mc, "doc_id", "content"))
