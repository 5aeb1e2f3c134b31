"""Training-data operators against brute force, edge cases and round trips."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from quantfold.llm import bpe, chat, decontam, lang_id, license_scan, line_dedup, lm, ngram_join, quality, queries, sharding  # noqa: E402
from quantfold.llm._common import SLICE_BYTES, components, text_buffers  # noqa: E402
from quantfold.session import ensure_checkpoint_dir  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "ONE", "a b c", "A b c", "É é E e", "x " * 3000, "x " * 3000, "\n\n\n", "一二 三四 五六"]


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.fixture(scope="module")
def texts():
    """Seeded texts with copies, near copies, shared passages and odd rows."""
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(300)] + ["the", "of"] * 40
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    out = [say(rng.randint(1, 120)) for _ in range(60)]
    base = say(150).split()
    for _ in range(30):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(150)] = say(1)
        out.append(" ".join(near))
    out += [out[3]] * 4
    return out + ODD


def frame(spark, rows, ids=None, clash=True):
    ids = list(range(len(rows))) if ids is None else ids
    schema = "doc_id long, text string, lang string, source string, n long, score string, item string, h long"
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 7) for i, t in zip(ids, rows)], schema)


def none(spark, columns="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame([], columns)


# 1 ------------------------------------------------------------------------

def test_language_id_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    model = lang_id.fit(docs)
    named = {r["doc_id"]: r for r in lang_id.predict(frame(spark, [None, "", "123 !?", "漢字漢字 漢字", "the of and to in"]), model).collect()}
    assert [named[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and all(named[i]["rejected"] for i in range(4))
    assert named[4]["lang_pred"] == "en" and not named[4]["rejected"] and 0 < named[4]["score"] <= 1


def test_language_id_registers_of_a_language_have_centroids(spark):
    rng = random.Random(2)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    texts = [say("abcdefg") for _ in range(388)] + [say("nopqrst") for _ in range(12)] + ["\u4e00\u4e8c", "\u3042\u3044"]
    model = lang_id.fit(frame(spark, texts))
    near = [int(np.argmax(model.centroids[:, at] @ v)) for at, v in map(model.vector, (texts[0], texts[390]))]
    assert len(model.langs) >= 2 and near[0] != near[1]
    assert all(float((model.centroids[:, at] @ v).max()) > 0.6 for at, v in map(model.vector, (texts[0], texts[390])))


def test_language_id_rejects_junk_despite_mislabelled_rows(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n))
    finnish = ("kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja "
               "omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä ") * 4
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    wrong = spark.createDataFrame([(-1 - i, junk(300), "en") for i in range(5)], "doc_id long, text string, lang string")
    out = lang_id.held_out(F.col("doc_id"))
    model = lang_id.fit(docs.filter(~out).unionByName(wrong))
    odd = lang_id.predict(frame(spark, [junk(300), junk(60), finnish]), model).collect()
    assert all(r["rejected"] for r in odd), odd
    kept = [not r["rejected"] for r in lang_id.predict(docs.filter(out), model).collect()]
    assert sum(kept) >= 0.97 * len(kept)


def test_language_id_without_rows_to_learn_from(spark):
    model = lang_id.fit(none(spark))
    assert [r["lang_pred"] for r in lang_id.predict(frame(spark, ["abc", None]), model).collect()] == ["und", "und"]
    assert lang_id.predict(none(spark), model).count() == 0


# 2 ------------------------------------------------------------------------

def brute_components(rows, size, percent):
    sets = {}
    for d, t in rows.items():
        w = WORD.findall(low(t))
        sets[d] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    label = {d: d for d in rows}
    links = [(a, b) for a in rows for b in rows if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {d: (len(sets[d]), label[d]) for d in rows}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(spark, texts, size, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(frame(spark, texts), size=size, percent=percent).collect()}
    assert got == brute_components(dict(enumerate(texts)), size, percent)


def test_ngram_join_odd_ids_and_keep_one(spark):
    t = "a b c d e f g h"
    got = ngram_join.link(frame(spark, [t, t, t, "z y x", t], ids=[None, 5, 5, None, 9])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got if r["n_shingles"] == 5) == [(-1, 5), (5, 5), (5, 5), (9, 5)]
    kept = ngram_join.keep_one(frame(spark, [t, t, "q r s", None]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3] and "score" in kept.columns
    assert ngram_join.link(none(spark)).count() == 0


def test_ngram_join_rounds_look_at_open_buckets_only(spark, monkeypatch):
    word = lambda *at: "w" + "x".join(map(str, at))
    near = [" ".join([word(g, i) for i in range(40)] + [word(g, "e", k)]) for g in range(20) for k in range(3)]
    blocks = [" ".join(word("b", b, i) for i in range(30)) for b in range(6)]
    texts = near + [f"{x} {y}" for i, x in enumerate(blocks) for y in blocks[i + 1:]]
    rows, keep = [], ngram_join.materialise

    def seen(df):
        out = keep(df)
        if out.columns[-1] == "c":
            rows.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", seen)
    monkeypatch.setattr(ngram_join, "FINISH", 0)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(frame(spark, texts)).collect()}
    assert got == brute_components(dict(enumerate(texts)), 4, 85)
    assert len(rows) > 1 and rows[1] < rows[0] / 2, rows


def test_ngram_join_opens_no_bucket_for_sets_that_reach_no_other(spark, monkeypatch):
    word = lambda *at: "w" + "x".join(map(str, at))
    every = [word("s", i) for i in range(265)]
    texts = [" ".join(every + [word("p", d // 2, i) for i in range(40)] + [word(d, i) for i in range(43)]) for d in range(6)]
    rows, keep = [], ngram_join.materialise

    def seen(df):
        out = keep(df)
        if "pivot" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", seen)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(frame(spark, texts)).collect()}
    assert got == brute_components(dict(enumerate(texts)), 4, 85)
    assert rows == [0]


def test_components_keep_the_estimated_size_and_one_round(spark):
    chain = [(n, n + 1) for n in range(1, 30)] + [(40, 51), (40, 52), (60, 60), (None, 3)]
    label = {n: 1 for n in range(1, 31)} | {n: 40 for n in (40, 51, 52)}
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("quantfold-*"))
    found = components(spark.createDataFrame(chain, "a long, b long"))
    # a product over all rounds' joins had thousands of bits, and many more with every call on its own result
    assert int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < 64
    assert {r["node"]: r["component"] for r in found.collect()} == label
    (made,) = set(folder.glob("quantfold-*")) - before
    assert sum(p.is_dir() for p in made.iterdir()) == 1


# 3 ------------------------------------------------------------------------

def reference_encoding():
    import public_tokenizers as public
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_reference_and_round_trips(spark, texts):
    more = texts + ["a" * 5000, "é" * 1500, "==" * 900 + " x", "it's we'll 12345 <|endoftext|>\r\n\t tab", "🙂👩‍👩‍👧 ok", "ABCabc" * 300]
    vocabulary, enc = queries.tokenizer(), reference_encoding()
    coded = bpe.encode(frame(spark, more), vocabulary, digest="ids_sha256")
    for r in bpe.decode(coded, vocabulary).collect():
        want = enc.encode_ordinary(more[r["doc_id"]] or "")
        assert r["ids"] == want and bytes(r["decoded"]) == (more[r["doc_id"]] or "").encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    with pytest.raises(ValueError):
        vocabulary.decode(np.array([10**6]))
    assert bpe.decode(bpe.encode(none(spark), vocabulary), vocabulary).count() == 0


def test_bpe_and_language_id_hold_few_texts_at_a_time():
    """pipeline: a task's Python worker keeps neither a batch of texts nor an array object a piece."""
    import pyarrow as pa
    vocabulary = queries.tokenizer()
    got = list(vocabulary.encode_batch(["the end of the end", None, "über"]))
    assert [x.tolist() for x, _ in got][1] == [] and vocabulary.decode(got[2][0]) == "über".encode()
    assert all(isinstance(ids, bytes) for ids, _ in vocabulary._known.values())

    class Noting:
        """A batch that notes the slices taken of it."""
        def __init__(self, batch):
            self.batch, self.taken = batch, []

        def slice(self, lo, n):
            self.taken.append(n)
            return self.batch.slice(lo, n)

        num_rows = property(lambda self: self.batch.num_rows)
        column = property(lambda self: self.batch.column)

    seen = Noting(pa.RecordBatch.from_arrays([pa.array(["the end"] * 1000)], names=["text"]))
    run = lang_id._counting(16)
    (found,) = run(iter([seen]))
    assert max(seen.taken) <= 256 and found.column(1).to_pylist()[-1] == 1000


# 4 ------------------------------------------------------------------------

def test_chat_collapse_and_render(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"),
            (4, 0, "user", "hi"), (4, 1, "assistant", "other"), (4, 1, "assistant", "other"), (5, None, None, None),
            (None, 0, "user", "lost"), (6, 0, "user", "<|im_end|>x")]
    got = {r["conv_id"]: r for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {2, 4, 5, 6} and got[2]["n_equal"] == 2 and got[4]["n_turns"] == 2
    assert got[2]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert got[5]["text"] == "<|im_start|>unknown\n<|im_end|>\n" and got[6]["text"].count("<|im_end|>") == 1
    assert chat.render(none(spark, "conv_id long, turn long, role string, text string")).count() == 0


# 5 ------------------------------------------------------------------------

def test_line_dedup_removes_later_passages_only(spark):
    rng = random.Random(3)
    line = lambda: " ".join("w%d" % rng.randrange(10**6) for _ in range(12))
    passage = [line() for _ in range(8)]
    rows = ["\n".join([line(), *passage, line()]), "\n".join([line(), line(), *passage]), "\n".join([*passage, line()]),
            "\n".join([passage[0], line()]), "\n".join(line() for _ in range(9)), None, "", "\n\n"]
    got = {r["doc_id"]: r for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert got[0]["text"] == rows[0] and got[0]["lines_removed"] == 0
    assert got[1]["lines_removed"] == got[2]["lines_removed"] == 8
    assert got[1]["text"] == "\n".join(rows[1].split("\n")[:2]) and got[2]["text"] == rows[2].split("\n")[-1]
    assert all(got[i]["text"] == rows[i] for i in range(3, 8))
    alive = {x for r in got.values() for x in (r["text"] or "").split("\n")}
    assert all(x in alive for t in rows if t for x in t.split("\n"))
    copies = line_dedup.dedup(frame(spark, [rows[0], rows[0], "x"]), drop_emptied=True)
    assert sorted(r["doc_id"] for r in copies.collect()) == [0, 2] and "score" in copies.columns
    assert line_dedup.dedup(none(spark)).count() == 0


def lines_removed_by_hand(rows):
    """Texts after removal: a line goes if it and a neighbour, or a long line alone, occurred before; runs under 10 words stay."""
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = {}, {}
    for pos, (doc_id, text) in enumerate(order):
        lines = text.split("\n")
        for i, x in enumerate(lines):
            if x.count(" ") >= 49:
                seen.setdefault((x,), (pos, i))
            if i + 1 < len(lines):
                seen.setdefault((x, lines[i + 1]), (pos, i))
    for pos, (doc_id, text) in enumerate(order):
        lines = text.split("\n")
        gone = [False] * len(lines)
        for i, x in enumerate(lines):
            if seen.get((x,), (pos, i)) != (pos, i):
                gone[i] = True
            if i + 1 < len(lines) and seen[x, lines[i + 1]] != (pos, i):
                gone[i] = gone[i + 1] = True
        for on, run in itertools.groupby(range(len(lines)), key=gone.__getitem__):
            run = list(run)
            if on and sum(len(lines[i].split()) for i in run) < 10:
                for i in run:
                    gone[i] = False
        out[doc_id] = "\n".join(x for x, g in zip(lines, gone) if not g)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(17)
    pool = [" ".join("v%d" % rng.randrange(50) for _ in range(rng.choice([1, 2, 4, 7, 60]))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25)))) for i in range(120)]
    rows += [(500, "\n".join(pool * 30)), (501, "a b c d e f\n" * 40), (502, ""), (503, None), (None, rows[3][1] + "\nlast")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, lines_removed int, t string").repartition(6)
    want = lines_removed_by_hand(rows)
    got = line_dedup.dedup(df).collect()
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] != 503} == want
    assert all(r["lines_removed"] == (t or "").count("\n") - (r["text"] or "").count("\n") or not r["text"]
               for r in got for i, t in rows if i == r["doc_id"])


@pytest.mark.parametrize("lines", [1, 2, 3, 4, 8])
def test_line_dedup_finds_passages_of_any_number_of_lines(spark, lines):
    rng = random.Random(lines)
    line = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    passages = [[line(-(-60 // lines)) for _ in range(lines)] for _ in range(40)]
    rows, planted = [], {}
    for k, passage in enumerate(passages):
        for _ in range(3):
            planted[len(rows)] = set(passage)
            rows.append("\n".join([line(12), line(9), *passage, line(15)]))
    got = {r["doc_id"]: r for r in line_dedup.dedup(frame(spark, rows)).collect()}
    left = {i for i, p in planted.items() if i % 3 and p & set(got[i]["text"].split("\n"))}
    assert not left and all(got[i]["text"] == rows[i] for i in range(0, len(rows), 3))
    assert all(got[i]["lines_removed"] == lines for i in range(len(rows)) if i % 3)


def test_line_dedup_looks_at_few_texts_at_a_time():
    rows = ["\n".join(f"line {i} {j} " + "word " * 20 for j in range(20)) for i in range(2000)] + ["", None]
    own = [[{"start": 3, "len": 2, "later": bool(i % 2)}] for i in range(2000)] + [None, None]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("later", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(own, kind)], names=["text", "__spans"])
    got = list(line_dedup._without(["text"], 10)([batch]))
    assert [x for b in got for x in b.column(0).to_pylist()] == [
        x if i % 2 == 0 or i >= 2000 else "\n".join(x.split("\n")[:3] + x.split("\n")[5:]) for i, x in enumerate(rows)]
    assert [x for b in got for x in b.column(1).to_pylist()] == [2 * (i % 2) for i in range(2000)] + [0, 0]
    lines = list(line_dedup._repeated_lines([batch.slice(0, 2000)]))
    assert sorted(x for b in lines for x in b.column(0).to_pylist()) == sorted(x for r in rows[:2000] for x in r.split("\n")[3:5])
    for made in (got, lines):  # 5 MB of texts in one batch
        assert len(made) > 5 and max(b.get_total_buffer_size() for b in made) < 2 * SLICE_BYTES


def test_line_dedup_compares_bytes(spark, monkeypatch):
    rows = ["one two three four five six\nseven eight nine ten eleven"] * 3
    looks = []
    real = line_dedup._share_a_hash
    monkeypatch.setattr(line_dedup, "_share_a_hash", lambda marked, seed: looks.append(seed) or real(marked, seed) or len(looks) == 1)
    got = line_dedup.dedup(frame(spark, rows)).collect()
    assert looks == [3, 4] and sorted(r["lines_removed"] for r in got) == [0, 2, 2]


# 6 ------------------------------------------------------------------------

def test_quality_counts_equal_brute_force(spark, texts):
    rows = texts + ["a b c d e " * 3 + "x", "#%& a|b\n\n same line\n same line\n", "q w e r t y u i o p a s d f g"]
    docs = frame(spark, rows)
    for r in quality.judge(docs).collect():
        t = rows[r["doc_id"]] or ""
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)), t
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality.judge(none(spark)).count() == 0


def test_quality_verdict_follows_labels_and_null_groups(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    assert sum(good) >= 0.98 * len(good) and sum(r["kept"] for r in got if r["quality"] == 0) <= 0.2 * sum(r["quality"] == 0 for r in got)
    odd = spark.createDataFrame([(1, "a b c d e f g h i j k", None, None)], "doc_id long, text string, lang string, source string")
    assert quality.judge(odd).first()["kept"]


def test_quality_has_no_largest_word_length(spark):
    rng = random.Random(9)
    word = lambda lo, hi: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(lo, hi)))
    rows = [" ".join(word(85, 115) for _ in range(30)) for _ in range(400)] + [" ".join(word(3, 7) for _ in range(30)) for _ in range(3)]
    rows += [" ".join(word(4000, 6000) for _ in range(30)) for _ in range(3)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(frame(spark, rows)).collect()}
    assert all(kept[i] for i in range(400)) and not any(kept[i] for i in range(400, 406))


def test_quality_cells_rise_and_return_to_their_edge(spark):
    values = [0, 1, 4095, 4096, 4097, 8191, 8192, 8193, 100_000, 10**9]
    df = spark.createDataFrame([(v, 64) for v in values], "word_chars long, n_words long").select(
        "word_chars", quality._cell("word_length").alias("q")).select("*", quality._edge("q").alias("edge"))
    got = {r["word_chars"]: (r["q"], r["edge"]) for r in df.collect()}
    cells = [got[v][0] for v in values]
    assert cells == sorted(cells) and cells[0] == 0 and max(cells) < 6000
    assert all(e <= v <= e * 66 // 64 for v, (_, e) in got.items())


def test_quality_repeats_can_decide(spark):
    plain = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(300)]
    loop = [" ".join(f"v{j}" for j in range(170)) + " a b c d e f g h i j k l m n o a b c d e f g h i j k l m n o"]
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, plain + loop)).collect()}
    assert not got[300]["base_failed"] and got[300]["failed"] == ["repeats"] and got[0]["kept"]


# 7 ------------------------------------------------------------------------

def test_license_scan_finds_every_notice(spark):
    rng = random.Random(1)
    say = lambda n: " ".join("w%d" % rng.randrange(500) for _ in range(n))
    rows, want = [], set()
    for i in range(60):
        name, notice = license_scan.TEMPLATES[i % len(license_scan.TEMPLATES)]
        rows.append(f"{say(rng.randint(0, 50))} {notice} {say(rng.randint(0, 50))}")
        want.add((i, name))
    rows += [say(80), None, "", "one", "license"]
    templates = spark.createDataFrame(license_scan.TEMPLATES, "license_id string, text string")
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in license_scan.scan(frame(spark, rows), templates).collect()}
    assert want <= set(got) and all(got[k] == 1.0 for k in want)
    assert all(d < 60 for d, _ in got)
    assert license_scan.scan(none(spark), templates).count() == 0 and license_scan.scan(frame(spark, rows), templates.limit(0)).count() == 0
    assert (1 - 4 / license_scan.WINDOW) ** license_scan.bands_for(4) <= 1e-3


# 8 ------------------------------------------------------------------------

def test_sharding_is_balanced_and_gapless(spark, texts):
    hot = ["same text here"] * 400
    rows = texts * 4 + hot
    got = sharding.assign(frame(spark, rows), shards=4, bundles=64).collect()
    assert len(got) == len(rows)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        t = (rows[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(size.values()) <= 1.1 * min(size.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    small = sharding.assign(frame(spark, ["a b c"] * 3 + ["d " * 50] * 3 + ["e f"] * 60), shards=2, pieces=1).collect()
    assert len({r["shard"] for r in small if r["doc_id"] < 3}) == 1  # a small group stays together
    assert sharding.assign(none(spark)).count() == 0


def test_sharding_keeps_groups_whole(spark):
    rng = random.Random(21)
    say = lambda: " ".join("w%d" % rng.randrange(10**6) for _ in range(rng.randint(5, 25)))
    groups = [say() for _ in range(40)]
    rows = [g for g in groups for _ in range(100)] + [say() for _ in range(4000)]
    got = sharding.assign(frame(spark, rows), shards=16).collect()
    where = collections.defaultdict(set)
    for r in got:
        where[rows[r["doc_id"]]].add(r["shard"])
    assert all(len(where[g]) == 1 for g in groups)
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) <= 1.03 * min(sizes.values())
    # a group above a shard's share is split, and only that one
    rows = [groups[0]] * 3000 + [g for g in groups[1:5] for _ in range(300)] + [say() for _ in range(4000)]
    got = sharding.assign(frame(spark, rows), shards=16).collect()
    where, sizes = collections.defaultdict(set), collections.Counter()
    for r in got:
        where[rows[r["doc_id"]]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert len(where[groups[0]]) > 4 and all(len(where[g]) == 1 for g in groups[1:5])
    assert max(sizes.values()) <= 1.05 * min(sizes.values())


# 9 ------------------------------------------------------------------------

def test_lm_base_counts_and_held_out_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fold = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 for r in docs}
    text = {r["doc_id"]: r["text"] for r in docs}
    count = collections.Counter()
    for d, t in text.items():
        if fold[d] != 2:
            count.update(WORD.findall(low(t)) + ["\n"])
    n = sum(count.values())
    base = model = 0.0
    for r in queries.op9_lm_score(spark, SF).collect():
        w = WORD.findall(low(text[r["doc_id"]])) + ["\n"]
        want = sum(math.log10((count[x] + 1) / (n + len(count) + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(count[x] > 0 for x in w), n, fold[r["doc_id"]] == 2)
        assert abs(r["base_score"] - want) <= 1e-9 * abs(want) + 1e-9
        if r["held_out"]:
            base, model = base + want, model + r["score"]
    assert model > base


@pytest.mark.parametrize("shards", [1, 7])
def test_lm_every_word_is_a_context(spark, shards):
    # every pair occurs once, so its tables are known; 3,000 contexts have less than 0.1% of the tokens each
    learned = [f"a{i} m{i % 40} b{i}" for i in range(1500)]
    asked = ["a3 m3 b43", "a5 m5", "a5 m6 b5 b6", "b21 new m1"]
    docs = frame(spark, learned + asked).withColumn("learn", F.col("doc_id") < len(learned))
    pair = collections.Counter()
    for t in learned:
        w = ["^", *t.split(), "$"]
        pair.update(zip(w, w[1:]))
    customers, open_, parent = collections.Counter(), collections.Counter(), collections.Counter()
    for (u, w), c in pair.items():
        customers[u], open_[u], parent[w] = customers[u] + c, open_[u] + 1, parent[w] + 1

    def p(u, w):
        up = (parent[w] - 0.7 if w in parent else 1 + 0.7 * len(parent)) / (1 + sum(parent.values()))
        return (max(pair[u, w] - 0.7 * (pair[u, w] > 0), 0) + (1 + 0.7 * open_[u]) * up) / (1 + customers[u])

    for r in lm.score(docs, shards=shards).collect():
        w = ["^", *(learned + asked)[r["doc_id"]].split(), "$"]
        assert abs(r["score"] - sum(math.log10(p(u, x)) for u, x in zip(w, w[1:]))) < 1e-4, (w, r["score"])


def test_lm_odd_rows_and_seating(spark):
    rows = frame(spark, ["a b a b a", None, "", "zzz"], ids=[1, 2, 3, None]).withColumn("learn", F.col("doc_id") == 1)
    got = {r["doc_id"]: r for r in lm.score(rows).collect()}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == 1 and got[None]["n_known"] == 1 and got[1]["train_tokens"] == 6
    assert lm.score(none(spark, "doc_id long, text string, learn boolean")).count() == 0
    nothing = lm.score(frame(spark, ["a b"]).withColumn("learn", F.lit(False))).first()
    assert nothing["train_tokens"] == 0 and nothing["score"] == 0.0
    rng = np.random.default_rng(0)
    c = np.array([1, 2, 50, 5000] * 500)
    t = lm.reseat(c, np.full(len(c), 3.0), rng)
    assert (t >= 1).all() and (t <= c).all() and t[c == 1].max() == 1
    # mean tables of 50 customers: the expectation of the sequential rule
    mean = np.zeros(2000)
    tables = np.ones(2000)
    for n in range(1, 50):
        tables += np.random.default_rng(n).random(2000) * (n - 0.7 * tables + 3.0) < 3.0
    mean = tables.mean()
    assert abs(t[c == 50].mean() - mean) < 0.1 * mean


def test_lm_memory_follows_the_tokens_not_the_bytes():
    rng = np.random.default_rng(3)
    rows = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(2000)] + ["", None, "One"]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["text"])
    tracemalloc.start()
    got = list(lm._many_tokens(batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    (lo, hi, tokens, bounds), = got
    assert (lo, hi, len(tokens)) == (0, len(rows), 2000 * 401 + 4) and peak < 5 * tokens.nbytes, peak / tokens.nbytes
    own, ends = lm._tokens(*text_buffers(batch.column(0).slice(0, 3)))
    assert ends.tolist() == bounds[:4].tolist() and (own == tokens[:ends[-1]]).all() and tokens[-2] == lm.Words.of(*text_buffers(pa.array(["one"]))).hashes[0]
    for x, y in zip(lm._distinct(tokens), np.unique(tokens, return_index=True, return_inverse=True)):
        assert (x == y).all()
    assert [len(x) for x in lm._distinct(tokens[:0])] == [0, 0, 0]


# 10 -----------------------------------------------------------------------

def test_decontamination_equals_brute_force(spark, texts):
    rng = random.Random(9)
    item = [rng.choice(["it%d" % i for i in range(40)] + ["the"] * 10) for _ in range(35)]
    items = [(1, " ".join(item)), (1, " ".join(item[:12])), (2, "Short One"), (3, None), (4, " "), (5, "x " * 12), (None, "lone é word")]
    rows = texts + ["pre " + " ".join(item[5:20]).upper() + " post", " ".join(item), " ".join(item[:9]), "a short, one!", "é lone É word lone é word",
                    " ".join("gap" if i % 9 == 0 else x for i, x in enumerate(item))]
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split.findall(low(t))
        for s in range(max(0, len(w) - min(10, len(w)) + 1) if w else 0):
            windows[tuple(w[s:s + 10])].add(i)
    got = decontam.scan(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        w, hit, names = split.findall(low(rows[r["doc_id"]])), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in windows:
                    hit |= set(range(s, s + k))
                    names |= windows[tuple(w[s:s + k])]
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (
            len(w), len(hit), sorted(str(x) for x in names if x is not None), bool(hit)), rows[r["doc_id"]][:80]
    near = next(r for r in got if r["doc_id"] == len(rows) - 1)
    assert "1" in near["near_items"]
    assert decontam.scan(none(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert not any(r["contaminated"] for r in decontam.scan(frame(spark, ["a b"]), none(spark, "item_id long, text string")).collect())


# pipeline -----------------------------------------------------------------

def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontaminate", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r["text"]))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        if name == "near_duplicates":
            rows = {r["doc_id"]: r["text"] for r in before.collect()}
            want = {d for d, (_, c) in brute_components(rows, 5, 80).items() if c == d}
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
        if name == "decontaminate":
            phrases = {w[i:i + 10] for w in bench for i in range(len(w) - 9)}
            def dirty(t):
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
                return any(tuple(w[i:i + 10]) in phrases for i in range(len(w) - 9))
            want = {r["doc_id"] for r in before.collect() if not dirty(r["text"])}
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
    enc = reference_encoding()
    last = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    for r in docs.collect():
        assert last[r["doc_id"]]["ids"] == enc.encode_ordinary(r["text"])
        assert last[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
