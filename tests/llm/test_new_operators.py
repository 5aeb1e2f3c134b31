"""Toxicity, whitening and token alignment against brute force, held-out rows and odd input."""

import collections
import hashlib
import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from quantfold.llm import queries, token_align, toxicity, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"

# 13 -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabularies():
    import public_tokenizers as public
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def aligned_by_hand(texts, tok):
    """Per text (A ids, B ids, common ends, links, digest) or None; pairs are compared one by one."""
    out = []
    for text in texts:
        (ok,), a, b = tok.encode([text])
        if not ok:
            out.append(None)
            continue
        a, b = a[0], b[0]
        span = lambda ids, table: [(e - len(table[i]), e) for i, e in zip(ids, np.cumsum([len(table[i]) for i in ids]))]
        sa, sb = span(a, tok.bytes_a), span(b, tok.bytes_b)
        links = [(x, y) for x, (s, e) in zip(a, sa) for y, (s2, e2) in zip(b, sb) if s < e2 and s2 < e]
        common = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for c in common:
            inside = lambda ids, spans: ",".join(str(i) for i, (_, e) in zip(ids, spans) if low < e <= c)
            groups.append(inside(a, sa) + "|" + inside(b, sb))
            low = c
        out.append((len(a), len(b), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def alignment_rows(texts, tok):
    hand = aligned_by_hand(texts, tok)
    count = collections.Counter(link for h in hand if h for link in h[3])
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return count, [(0, 0, 0, 0, 0, 0, "") if h is None else
                   (h[0], h[1], h[2], len(h[3]), sum(count[x] == best[x[1]] for x in h[3]), sum(count[x] for x in h[3]), h[4])
                   for h in hand]


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_comparing_all_pairs(spark, vocabularies):
    rng = random.Random(3)
    words = ["the", "and", "straße", "été", "niño", "Überzeugung", "x=1;", "12345", "tokenization", "<|endoftext|>", "</s>", "  ", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    texts += [None, "", " ", "a", "a", "ﬁ ligature", "▁ sign", "日本語のテキスト", "😀😀", "tab\tand\r\nline", "\x00nul", "aaaa" * 50, "é" * 9]
    ids = [None, *range(1, len(texts) - 1), 1]
    docs = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in zip(ids, texts)],
                                 "doc_id long, text string, part int, kind string, n long").repartition(3)
    tok = token_align.Tokenizers(*vocabularies)
    count, wanted = alignment_rows(texts, tok)
    got = [(r["doc_id"], *[r[c] for c in ALIGNED]) for r in token_align.align(docs, *vocabularies, block_bytes=300).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(((i, *w) for i, w in zip(ids, wanted)), key=key)
    assert sum(w[0] == 0 for w in wanted) >= 3  # null, empty, the sign that B writes for a space
    pairs = {(r["a"], r["b"]): (r["n"], r["same_bytes"]) for r in token_align.pair_table(docs, *vocabularies).collect()}
    assert {k: n for k, (n, _) in pairs.items()} == dict(count)
    assert all(tok.bytes_a[a] == tok.bytes_b[b] for (a, b), (_, same) in pairs.items() if same)


def test_alignment_does_not_depend_on_blocks_or_partitions(spark, vocabularies):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    one = token_align.align(docs.coalesce(1), *vocabularies).collect()
    many = token_align.align(docs.repartition(7), *vocabularies, block_bytes=2000).collect()
    assert sorted(one) == sorted(many)


def test_alignment_of_nothing_and_of_one_long_text(spark, vocabularies):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.align(none, *vocabularies).collect() == []
    long_text = "antidisestablishmentarianism übermäßig " * 20_000
    row = token_align.align(spark.createDataFrame([(1, long_text)], "doc_id long, text string"), *vocabularies).first()
    assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] and row["n_a"] > 20_000


def test_alignment_encodes_a_piece_once(vocabularies):
    """Words seen before are not encoded again, and cutting at spaces changes no ids."""
    from types import SimpleNamespace
    tok = token_align.Tokenizers(*vocabularies)
    assert tok.by_piece
    real, seen = tok.a, []

    def counted(texts, **options):
        seen.extend(texts)
        return real.encode_batch_fast(texts, **options)
    tok.a = SimpleNamespace(encode_batch_fast=counted)
    tok.encode(["the end of the end"])
    assert sorted(seen) == [" end", " of", " the"]
    assert tok.encode(["end of", None, "the"])[0] == [True, False, True] and len(seen) == 3
    odd = ["a  b", " a", "a ", "a  ", "\n a\n  b \n", "a\u00a0 b", "x\x1c y", "\u3000 z", "don't 's  12 3", "日本 語", "</s> <0x41>", " ", "\t"]
    valid, ids_a, ids_b = tok.encode(odd)
    assert all(valid)
    assert [x.tolist() for x in ids_a] == [real.encode(" " + t, add_special_tokens=False).ids for t in odd]
    assert [x.tolist() for x in ids_b] == [list(tok.b.encode(t)) for t in odd]


def test_alignment_joins_new_pieces(vocabularies):
    """Many new pieces are encoded as few texts, with the ids that each text has by itself."""
    from types import SimpleNamespace
    tok = token_align.Tokenizers(*vocabularies)
    real, seen = tok.a, []

    def counted(texts, **options):
        seen.extend(texts)
        return real.encode_batch_fast(texts, **options)
    tok.a = SimpleNamespace(encode_batch_fast=counted)
    rng = random.Random(5)
    words = ["".join(rng.choice("aeionrst'é日0,") for _ in range(rng.randint(1, 9))) for _ in range(700)]
    texts = [" ".join(words[i:i + 70]) for i in range(0, 700, 70)]
    texts += ["a  b", "\n a\n  b \n", "end ", "x\x1c y", "\u3000 z", "</s> <0x41>", " ", "q" * 100 + " r"]
    for given in (texts, [t + " ▁" + t for t in texts]):
        valid, ids_a, ids_b = tok.encode(given)
        good = [t for t, ok in zip(given, valid) if ok]
        assert len(good) == (len(texts) if given is texts else 0)
        assert [x.tolist() for x in ids_a] == [real.encode(" " + t, add_special_tokens=False).ids for t in good]
        assert [x.tolist() for x in ids_b] == [list(tok.b.encode(t)) for t in good]
    assert len(seen) < 100


# 12 -----------------------------------------------------------------------

def test_products_are_exact_for_any_long():
    rng = np.random.default_rng(1)
    for bits in (8, 21, 40, 62):
        x = rng.integers(-(1 << bits), 1 << bits, (9000, 3))
        exact = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(3)] for i in range(3)]
        assert whitening.exact_products(x).tolist() == exact


def test_polynomial_and_roots_are_exact(spark):
    rng = np.random.default_rng(2)
    b = rng.integers(-9, 10, (12, 7)).astype(object)
    m = b.T @ b
    poly = whitening.polynomial(spark, m)
    # Faddeev-LeVerrier with integers
    want, work = [1], np.zeros((7, 7), object)
    for k in range(1, 8):
        work = m @ work + want[-1] * np.eye(7, dtype=int).astype(object)
        want.append(-int(np.trace(m @ work)) // k)
    assert poly == want[::-1]
    roots, s = whitening.largest_roots(poly, 7)
    got = np.array([r / (1 << s) for r, _ in roots])
    assert np.allclose(got, np.linalg.eigvalsh(m.astype(float))[::-1], rtol=1e-12)
    # roots 5, 5, 3, 0 with their multiplicities
    roots, s = whitening.largest_roots([0, -75, 55, -13, 1], 4)
    assert [(r >> s, k) for r, k in roots] == [(5, 2), (3, 1)]


def frame_of(spark, vectors):
    return spark.createDataFrame([(i, [None if v is None else float(v) for v in vec] if vec is not None else None, 1, "c")
                                  for i, vec in enumerate(vectors)], "vec_id long, embedding array<double>, n long, component string")


def whitened_rows(df, components=32):
    out = whitening.whiten(df, components).toPandas()
    return out, out.sort_values(["vec_id", "component"])


def test_whitening_against_numpy_with_dropped_rows(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
    rows = [list(v) for v in good] + [None, [1.0] * 5 + [None], [math.nan] * 6, [math.inf] + [0.0] * 5, [1.0] * 4, [], [1e300] * 6]
    df = frame_of(spark, rows).repartition(3)
    _, got = whitened_rows(df, 4)
    assert len(got) == 80 * 4 and set(got["n"]) == {80} and got["identity_error"].iloc[0] < 1e-9
    x = np.floor(64 * good).astype(np.int64) + 1_000_000
    v = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    want = (x - x.mean(0)) @ vectors[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    found = got["whitened"].to_numpy().reshape(80, 4)
    assert np.allclose(want * np.sign((want * found).sum(0)), found, atol=1e-8)
    assert np.allclose(got["explained"].to_numpy()[:4], (values[::-1] / values.sum())[:4], rtol=1e-10)
    s = x.sum(0)
    assert [int(d) for d in got["deviation"][::4]] == [int(((80 * r - s) ** 2).sum()) for r in x]


def test_whitening_with_equal_eigenvalues_and_low_rank(spark):
    d = 5
    corners = [[sign * (i == k) for i in range(d)] + [7.0, 7.0] for k in range(d) for sign in (2.0, -2.0)]
    _, got = whitened_rows(frame_of(spark, corners))
    w = got["whitened"].to_numpy().reshape(10, d)  # two constant entries have no component
    assert np.allclose(w.T @ w / 10, np.eye(d), atol=1e-9)
    assert np.allclose(got["explained"], 1 / d)


def test_whitening_of_too_little(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(frame_of(spark, [[1.0, 2.0]])).collect() == []
    assert whitening.whiten(frame_of(spark, [[1.0, 2.0]] * 5 + [None])).collect() == []


def test_whitening_of_large_entries(spark):
    rng = np.random.default_rng(6)
    big = rng.normal(size=(40, 3)) * 1e12
    _, got = whitened_rows(frame_of(spark, big.tolist()))
    w = got["whitened"].to_numpy().reshape(40, 3)
    assert np.allclose(w.T @ w / 40, np.eye(3), atol=1e-9)


# 11 -----------------------------------------------------------------------

def toxic_corpus(n=1500, seed=7):
    rng = random.Random(seed)
    syllables = ["ba", "re", "mi", "ton", "la", "ver", "sho", "pel", "dan", "gu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 4) if toxic else 0):
            # words never seen before, known only by their beginning
            words.insert(rng.randrange(len(words)), "grozz" + word() if rng.random() < 0.7 else "zlonk")
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "en", 3.0, "x") for i, t, _ in rows], "doc_id long, text string, lang string, score double, raw string")
    labels = spark.createDataFrame([(i, x, 1) for i, _, x in rows], "doc_id long, toxic int, calibrate int")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels, ~out, trees=10).collect()}
    held = {r["doc_id"] for r in docs.filter(out).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)
    caught = [got[i] >= 0.5 for i, _, x in rows if x and i in held]
    false = [got[i] >= 0.5 for i, _, x in rows if not x and i in held]
    assert sum(caught) >= 0.95 * len(caught) and sum(false) <= 0.02 * len(false)


def test_lexicon_counts_equal_counting_by_hand(spark):
    rows = toxic_corpus(300, 8)
    df = spark.createDataFrame([(t, x) for _, t, x in rows], "text string, toxic int").repartition(4)
    got = {r["entry"]: r["n"] for r in toxicity.document_counts(df, flush=50).collect()}
    want = collections.Counter()
    for _, t, _ in rows:
        want.update({e for w in t.split() for e in toxicity.entries_of(w)})
    assert got == want
    lexicon = toxicity.learn_lexicon(df)
    assert "zlonk" in lexicon and "groz-" in lexicon and not {"ba", "ton"} & set(lexicon)


def test_features():
    scorer = toxicity.Scorer({"zlonk": 3.0, "groz-": 2.0})
    f = lambda t: dict(zip(toxicity.FEATURES, scorer.features(t)))
    plain = f("you are a zlonk and a Grozzuli")
    assert plain["hits"] == pytest.approx(math.log1p(2)) and plain["weight_top"] == 3.0 and plain["near_you"] == pytest.approx(math.log1p(1))
    assert f("y0u zl0nk st@pid ID1OT now")["disguised_hits"] == 2.0
    assert f("WHY LOUD")["shouted"] == 1.0 and f("soooo")["letter_runs"] == 1.0
    assert f("") == dict.fromkeys(toxicity.FEATURES, 0.0)


def test_toxicity_odd_rows_and_labels(spark):
    odd = [None, "", "\n \t", "x" * 50_000, "the " * 20_000, "ü" * 9, "a a", "a a"]
    docs = spark.createDataFrame([(None if i == 2 else i % 7, t, 1, "v") for i, t in enumerate(odd)],
                                 "doc_id long, text string, label int, features string")
    everything = F.lit(True)
    score = lambda labels: [r["score"] for r in toxicity.score(
        docs, spark.createDataFrame(labels, "doc_id long, toxic int"), everything).collect()]
    assert score([]) == [0.0] * 8
    assert score([(1, None), (None, 1)]) == [0.0] * 8
    assert score([(i, 1) for i in range(7)]) == [1.0] * 8
    both = score([(i, i % 2) for i in range(7)] + [(0, 0), (99, 1)])
    assert len(both) == 8 and all(0 <= s <= 1 for s in both)
    none = docs.limit(0)
    assert toxicity.score(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), everything).collect() == []


def test_queries_have_the_contract_columns(spark):
    assert queries.op11_toxicity(spark, SF).columns == ["doc_id", "held_out", "score", "predicted"]
    found = queries.op12_whitening(spark, SF)
    assert dict(found.dtypes)["deviation"] == "bigint" and found.count() % 32 == 0
    row = queries.op13_token_align(spark, SF).first()
    assert set(row.asDict()) == {"doc_id", *ALIGNED}
