"""Fixtures for text and link operators (FIXTURES §2 rows 13-20, 23) plus brute-force properties."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quantfold.functions import text as T
from quantfold.operators import links as L
from quantfold.operators import text as X
from quantfold.operators.ranking import numbered
from conftest import rows


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr).collect()[0][0]


def test_minutes_first_regex(spark):
    assert one(spark, F.regexp_replace("s", T.MINUTES_STRIP, ""), "rba: see http://x.y/z ok") == "ba see  ok"


def test_minutes_capital_split(spark):
    assert one(spark, F.regexp_replace("s", T.CAPITAL_SPLIT, " "), "MembersNoted thatRBA") == " Members Noted that R B A"


def test_replacement_chain_order(spark):
    assert one(spark, T.replace_chain("s"), "nancial and financial") == "financial and financial"


def test_digits_and_hits(spark):
    assert one(spark, T.digit_count("s"), "a1b22") == 3
    assert one(spark, T.lexicon_hits("s", ["inflation"]), "inflation inflationary") == 2
    assert one(spark, T.lexicon_hits_expr("s", ["inflation"]), "inflation inflationary") == 2


def test_missing_marker_is_null(spark):
    assert one(spark, T.between_markers("s", "start", "end"), "start here, no finish") is None
    assert one(spark, T.between_markers("s", "start", "end"), "x start y end z") == "start y "


def test_keyword_sentences(spark):
    df = spark.createDataFrame([("A k. B. C k",)], "s string").select(T.split_sentences("s").alias("a"))
    assert df.select(T.keyword_sentences("a", ["k"])).collect()[0][0] == "A k B C k"


def test_page_clean(spark):
    raw = "Hello World! see https://x.y/z?q=1 Nice\nday, 2023."
    assert one(spark, T.clean_page("s"), raw) == "hello world see nice day, 2023."


def _tfidf(corpus, text):
    tok = lambda s: re.findall(r"[^\W_]{2,}|\w{2,}", s.lower())
    docs = [Counter(tok(c)) for c in corpus]
    n = len(docs)
    df = Counter(t for d in docs for t in d)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}

    def vec(c):
        v = {t: c[t] * idf[t] for t in c if t in idf}
        nrm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / nrm for t, x in v.items()} if nrm else {}

    cv = [vec(d) for d in docs]
    dv = vec(Counter(tok(text)))
    return sum(sum(dv.get(t, 0) * w for t, w in c.items()) for c in cv) / n


def test_similarity_equals_brute_force_mean_cosine(spark):
    corpus = ["rates rose and inflation eased", "the board kept rates steady", "growth outlook weak, inflation high",
              "labour market tight and wages rising"]
    texts = ["inflation and rates", "nothing relevant here", "wages rising in a tight market", "rates rates rates"]
    cdf = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, content string")
    tdf = spark.createDataFrame(list(enumerate(texts)), "id long, txt string")
    cen = X.corpus_centroid(cdf, "doc_id", "content")
    got = {i: s for i, s in rows(X.similarity_to_corpus(tdf, ["id"], "txt", cen), "id", "score")}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(_tfidf(corpus, t), abs=1e-12)
    assert got[1] == 0.0


def test_similarity_identity_and_unknown(spark):
    cdf = spark.createDataFrame([(0, "policy rates steady")], "doc_id long, content string")
    tdf = spark.createDataFrame([(0, "policy rates steady"), (1, "zzz qqq")], "id long, txt string")
    got = dict(rows(X.similarity_to_corpus(tdf, ["id"], "txt", X.corpus_centroid(cdf, "doc_id", "content")), "id", "score"))
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0


def test_top_fraction_and_global_rank(spark):
    df = spark.createDataFrame([(i, float((i * 37) % 85)) for i in range(85)], "id int, s double")
    top = rows(X.top_fraction(df, "s", [F.col("id")], 0.025), "id", "s")
    assert len(top) == 2 and sorted(s for _, s in top) == [83.0, 84.0]
    ranked = sorted(rows(numbered(df, [F.col("s").desc(), F.col("id")], partitions=4), "rank", "s"))
    assert [r for r, _ in ranked] == list(range(1, 86))
    assert [s for _, s in ranked] == sorted((s for _, s in rows(df, "id", "s")), reverse=True)


def test_first_by_keeps_first_copy(spark):
    df = spark.createDataFrame([("a", 2, 0), ("a", 1, 5), ("b", 1, 1)], "sentence string, page int, pos int")
    out = sorted(rows(X.first_by(df, "sentence", ["page", "pos"], ["page", "pos"])))
    assert out == [("a", 1, 5), ("b", 1, 1)]


def test_word_start_rule(spark):
    df = spark.createDataFrame([("/AnnualReport.pdf",), ("/annual-report.pdf",)], "u string")
    got = [r[0] for r in rows(df.select(T.has_all_words_at_word_start("u", ["Annual", "Report"])))]
    assert got == [False, True]


def test_absolute_url(spark):
    base = "https://h.example.com/a/b/page.html?x=1#f"
    cases = {"/x.pdf": "https://h.example.com/x.pdf", "y.pdf": "https://h.example.com/a/b/y.pdf",
             "//cdn.example.com/z": "https:" + "//cdn.example.com/z", "http://o.example/p": "http://o.example/p",
             "?q=2": "https://h.example.com/a/b/page.html?q=2", "#top": "https://h.example.com/a/b/page.html?x=1#top"}
    df = spark.createDataFrame([(h, base) for h in cases], "h string, b string")
    got = dict(rows(df.select("h", L.absolute_url("h", "b").alias("u"))))
    assert got == cases


def test_stored_tfidf_applied_to_another_corpus(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "")], "id int, text string")
    path = X.save_tfidf(corpus, "id", "text", str(tmp_path / "model"))
    terms = {r["token"]: (r["df"], r["idf"]) for r in X.load_tfidf(spark, path).collect()}
    assert terms["alpha"] == (2, pytest.approx(math.log(4 / 3) + 1)) and terms["beta"] == (1, pytest.approx(math.log(4 / 2) + 1))
    other = spark.createDataFrame([(7, "Beta alpha unseen beta"), (8, "unseen words"), (9, None), (10, "gamma")], "id int, text string")
    got = {(r["id"], r["token"]): r["w"] for r in X.tfidf_transform(other, ["id"], "text", X.load_tfidf(spark, path)).collect()}
    raw = {"beta": 2 * terms["beta"][1], "alpha": terms["alpha"][1]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert got == {(7, k): pytest.approx(v / norm) for k, v in raw.items()} | {(10, "gamma"): pytest.approx(1.0)}
    spark.createDataFrame([(3, "other")], "documents long, token_pattern string").write.mode("overwrite").parquet(f"{path}/settings")
    with pytest.raises(ValueError, match="other tokens"):
        X.load_tfidf(spark, path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _pages(spark, path, texts):
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string") \
        .write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "Inflation rose and the outlook weakened")], "item_id long, text string") \
        .write.parquet(f"{path}/benchmark.parquet")


def test_paragraphs_take_their_own_sentences_only(spark, tmp_path):
    """h10: a text is cleaned and cut once, and no sentence walks the whole text's array."""
    from __spark_entry__ import queries
    _pages(spark, tmp_path, ["a. b. c. d", "one", "", None, "x. http://y z  w\u00a0\u00e9q"])
    df = queries()["h10_paragraphs"](spark, str(tmp_path))
    got = sorted(rows(df))
    assert got == [(0, 0, "a", "a b c"), (0, 1, "b", "a b c"), (0, 2, "c", "a b c"), (0, 3, "d", "d"), (1, 0, "one", "one"),
                   (2, 0, "", ""), (4, 0, "x", "x z w q"), (4, 1, "z w q", "x z w q")]
    assert _plan(df).count("http") == 1 and "transform(" not in _plan(df)


def test_similarity_deals_texts_once(spark, tmp_path):
    """h13: the texts travel once, by their ids; no token row does."""
    from __spark_entry__ import queries
    _pages(spark, tmp_path, ["inflation rose. the outlook. weakened. inflation", "unknown", "", None])
    df = queries()["h13_similarity_paragraphs"](spark, str(tmp_path))
    got = {(p, b): s for p, b, s in rows(df)}
    assert got[0, 1] > got[0, 2] > 0 and got[1, 1] == 0.0 and got[2, 1] is None and len(got) == 4
    dealt = [line for line in _plan(df).splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 1 and "token" not in dealt[0]


def test_selection_cleans_a_page_once(spark):
    """h18: a page is cleaned once, also where pages with a phrase are left out."""
    df = spark.createDataFrame([(1, "A. b"), (2, "see notes to the accounts"), (3, None)], "page_no long, text string")
    df = df.select("page_no", T.clean_page("text").alias("content"))
    s = X.explode_sentences(df, "content", skip_if_contains="notes to the").drop("content")
    assert sorted(rows(s)) == [(1, 0, "a"), (1, 1, "b")]
    assert _plan(s).count("http") == 1
