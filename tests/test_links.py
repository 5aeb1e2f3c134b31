"""Link harvesting on fixture pages: tag shapes, predicates, best report, pages without links."""

from quantfold.operators import links as L

PAGES = {
    1: """<a class="x" href="/one.pdf">One</a><A HREF='/two'>Two <b>bold</b></A><a href=three data-href="/no">3</a>""",
    2: "<link href='/style.css'><!-- <a href='/hidden'>no</a> --><script>var a='<a href=\"/js\">x</a>';</script><p>no links</p>",
    3: None,
    4: "",
    5: """<a title="a > b, href=/fake" href="/real?x=1&amp;y=2">A &amp; B</a><abbr href="/abbr">n</abbr><a name="top">t</a>
<a
 href = "/spaced" >line
break</a><a href="">empty</a><a href="/open""",
    6: '<a href="https://google.com/search">g</a><a href="http://x.org/2021/Annual-Report.pdf">r21</a>'
       '<a href="/2023/annual report.pdf">r23</a><a href="/2024/annual-report.html">page</a><a href="/2023/AnnualReport.pdf">joined</a>',
}


def pages(spark):
    return spark.createDataFrame([(i, "https://site.net/dir/p.html", h) for i, h in PAGES.items()], "page_id int, url string, html string")


def found(df, *cols):
    out = {}
    for r in df.orderBy("source_id", "pos").collect():
        out.setdefault(r["source_id"], []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return out


def test_tags_of_every_shape(spark):
    links = found(L.extract_links(pages(spark)), "href", "text")
    assert links[1] == [("/one.pdf", "One"), ("/two", "Two bold"), ("three", "3")]
    assert 2 not in links and 3 not in links and 4 not in links
    assert links[5] == [("/real?x=1&y=2", "A &amp; B"), ("/spaced", "line\nbreak"), ("", "empty")]
    assert found(L.extract_links(pages(spark)), "pos")[5] == [0, 1, 2]


def test_predicates_and_first_k(spark):
    p = pages(spark)
    assert found(L.extract_links(p, pattern=r".+\.pdf"), "href")[6] == [
        "http://x.org/2021/Annual-Report.pdf", "/2023/annual report.pdf", "/2023/AnnualReport.pdf"]
    assert found(L.extract_links(p, pattern="^http", must_not=["google.com"], k=4), "href") == {6: ["http://x.org/2021/Annual-Report.pdf"]}
    assert found(L.extract_links(p, must=["2023", "annual"]), "href") == {6: ["/2023/annual report.pdf"]}
    # the first k are counted after the filter, positions are the document's
    assert found(L.extract_links(p, pattern=r".+\.pdf", k=1), "href", "pos")[6] == [("http://x.org/2021/Annual-Report.pdf", 1)]


def test_best_report_and_sources_without_one(spark):
    p = pages(spark)
    assert [tuple(r) for r in L.best_link(p, ["Annual", "Report"]).collect()] == [(6, "https://site.net/2023/annual report.pdf")]
    hits = {r["source_id"]: r["found"] for r in L.hits_per_source(p, ["Annual", "Report"], r".+\.pdf").collect()}
    assert hits == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}


def test_long_attributes_and_unclosed_quotes(spark):
    long = '<a title="' + "x " * 50_000 + '" href="/far">t</a>' + "<a " + 'k="v" ' * 20_000 + 'href="/many">u</a>' + '<a href="/never ' + "y" * 100_000
    df = spark.createDataFrame([(1, "http://h/", long)], "page_id int, url string, html string")
    assert found(L.extract_links(df), "href") == {1: ["/far", "/many"]}


def test_links_need_no_shuffle(spark):
    for df in (L.extract_links(pages(spark), k=3), L.best_link(pages(spark), ["Annual"]), L.hits_per_source(pages(spark), ["Annual"])):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
