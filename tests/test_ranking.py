"""Numbers and top shares against Python's sort, with hot keys, ties and missing scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quantfold.operators import ranking
from quantfold.operators.ranking import numbered, top_rows
from quantfold.sources import readers as R
from quantfold.sources import sinks as S


def hot_rows(n=2000, seed=1):
    """(key, order): nine tenths of the rows in one key."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.9 else rng.choice(["a", None, "z"]), i) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_numbers_within_a_hot_key(spark, monkeypatch, limit):
    monkeypatch.setattr(ranking, "BROADCAST_OFFSETS", limit)
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, o int").repartition(7)
    got = numbered(df, [F.col("o").desc()], ["k"], total="size", partitions=16)
    want = {}
    for key in {k for k, _ in rows}:
        mine = sorted((o for k, o in rows if k == key), reverse=True)
        want |= {(key, o): (i + 1, len(mine)) for i, o in enumerate(mine)}
    assert {(r["k"], r["o"]): (r["rank"], r["size"]) for r in got.collect()} == want


def test_a_hot_key_is_spread_and_nothing_is_sorted_whole(spark):
    df = spark.createDataFrame(hot_rows(), "k string, o int")
    got = numbered(df, [F.col("o")], ["k"], partitions=16)
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 600
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_pages_of_one_large_report_and_rejects(spark):
    pages = [(k or "none", o, "" if o % 50 == 0 else None if o % 51 == 0 else "text") for k, o in hot_rows(800, 2)]
    df = spark.createDataFrame(pages, "report string, page int, content string")
    good, bad = R.load_pages(df, "report", "page", "content")
    assert bad.count() == sum(not c for *_, c in pages) > 0
    for report in ("hot", "a"):
        mine = sorted(p for r, p, c in pages if r == report and c)
        assert [r["page"] for r in good.where(F.col("report") == report).orderBy("page_in_report").collect()] == mine


@pytest.mark.parametrize("k", [0, 1, 7, 60, 150, 290, 300, 999])
def test_top_rows_with_ties_and_missing_scores(spark, k):
    rng = random.Random(3)
    rows = [(i, rng.choice([1.0, 2.0, 2.0, 3.5, -1.0, math.inf if i == 5 else 0.0])) for i in range(280)]
    rows += [(i, None if i % 2 else math.nan) for i in range(280, 300)]
    df = spark.createDataFrame(rows, "id int, s double").repartition(5)
    real = lambda s: s is not None and not math.isnan(s)
    want = sorted(rows, key=lambda r: (not real(r[1]), -r[1] if real(r[1]) else 0, r[0]))[:k]
    assert sorted(r["id"] for r in top_rows(df, "s", [F.col("id")], k=k).collect()) == sorted(i for i, _ in want)


def test_empty_input(spark):
    none = spark.createDataFrame([], "k string, o int")
    assert numbered(none, [F.col("o")], ["k"]).collect() == []
    assert top_rows(none, "o", [F.col("k")], fraction=0.5).collect() == []


def test_joined_texts_per_cluster(spark, tmp_path):
    df = spark.createDataFrame([(c, i, f"s{i}") for i in range(40) for c in ([0, 1] if i % 4 else [0])], "c int, o int, text string")
    path = S.write_cluster_texts(df, "c", "text", ["o"], str(tmp_path / "all"))
    for c in (0, 1):
        lines = [line for f in sorted((tmp_path / "all" / f"cluster={c}").glob("part-*")) for line in f.read_text().split("\n")[:-1]]
        assert "".join(lines) == ". ".join(f"s{i}" for i in range(40) if c == 0 or i % 4)
    one = spark.read.text(S.write_cluster_texts(df, "c", "text", ["o"], str(tmp_path / "one"), only=1))
    assert one.select("cluster").distinct().collect()[0][0] == 1 and one.count() == 30 and path
