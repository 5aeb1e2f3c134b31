"""Language-model scoring with a hierarchical Pitman-Yor model.

The hierarchy of restaurants, from the leaves to the base:

* a restaurant for each context. The context of a token is the word before it,
  whatever its frequency, or the start of the text;
* their common parent, the restaurant of all words: each table of a context
  restaurant is one of its customers;
* a diffuse base, whose draws are words never seen. They are one event, as in
  the add-one rule of ``base_score``.

    P(w | u) = (c_uw - d t_uw + (theta + d T_u) P(w)) / (theta + C_u)
    P(w)     = (c_w  - d      + 0)                    / (theta + C)    for a seen word
    P(new)   = (theta + d T)                          / (theta + C)

with c customers and t tables of a dish, C and T of a restaurant, and c_w the
tables of w in all contexts. The probabilities of all seen words and of the
event "new word" sum to one in every context.

Seating is sampled. In a sweep the customers of every dish leave their context
restaurant and are seated again one after the other by the Chinese-restaurant
rule, given the other dishes' tables and the parent's prediction (a blocked
Gibbs step; long waits until the next new table are drawn at once). The first
sweeps are dropped, the table counts of the others, in which the predictive
probabilities are linear, are averaged.

On Spark:

1. One pass finds the *hot* words, which make at least ``1 / (4 shards)`` of all
   tokens (words with half that share in some piece of text report their
   counts there: no hot word can be missed; at most ``4 shards`` exist).
2. One pass turns the texts into *batches*: per batch the distinct (word,
   context) pairs with their training counts, and the texts as numbers into
   that list. Only distinct pairs travel, never the tokens.
3. Pairs are dealt by hash of the word to shards, those of a hot word by hash of
   the pair, so that no shard gets a hot word whole. The contexts and the hot
   words span shards: they are *keys*, dealt by their own hash. Shards send
   the keys' partial numbers of pairs and get back the exact ones.
4. A shard adds up its counts and samples the seats. While sampling, the tables
   of a key are its own ones, scaled by the key's pairs in all shards to those
   here. It answers every batch in the batch's order, and sends the keys'
   customers and tables.
5. The exact customers and tables of every key are added up where the key was
   dealt to and answer the batches that have it; a batch meets its answers
   and scores its texts. Nothing that grows with the vocabulary is collected.

Words are identified by 64-bit hashes.

Edge cases: null and empty texts are one end token. Rows without doc_id are
scored and not learned from (their crc32 is null). With nothing to learn from
every token is new with probability one: score 0. Repeated rows are scored
alike and each counts in training. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SLICE_BYTES, Shared, Words, give_back, materialise, mix, release, slices

#: Bytes of text a batch holds (a longer document is a batch of its own), and bytes split into words at once.
BATCH_BYTES, PIECE_BYTES = 16 << 20, 4 << 20
_U = np.uint64
#: Stands for the end of a text among the word hashes.
END_HASH = mix(np.array([0xE0D0F7E87], np.uint64))[0]
#: The context at the start of a text.
START_HASH = mix(np.array([0x57A27], np.uint64))[0]
DISCOUNT, THETA = 0.7, 1.0
DROPPED, KEPT = 2, 4
_ONE_BY_ONE = 64


def reseat(count: np.ndarray, weight: np.ndarray, rng: np.random.Generator, d: float = DISCOUNT) -> np.ndarray:
    """Tables after seating ``count`` customers of each dish by the Chinese-restaurant rule.

    ``weight`` is the dish's weight for a new table, ``(theta + d T) P(dish)``.
    The first customers are seated one by one; beyond that the waiting time
    until the next new table has the survival ``((n - d t) / (m - d t)) ** weight``
    and is drawn at once.
    """
    tables = np.minimum(count, 1).astype(np.int64)
    live = np.flatnonzero(count > 1)
    for n in range(1, _ONE_BY_ONE):
        live = live[count[live] > n]
        if not len(live):
            return tables
        old = n - d * tables[live]
        tables[live] += rng.random(len(live)) * (old + weight[live]) < weight[live]
    seated = np.full(len(live), float(_ONE_BY_ONE))
    while len(live):
        u = np.maximum(rng.random(len(live)), 1e-300)
        with np.errstate(over="ignore"):
            arrives = d * tables[live] + (seated - d * tables[live]) * u ** (-1.0 / np.maximum(weight[live], 1e-12))
        new = np.maximum(np.ceil(arrives), seated + 1)
        on = new <= count[live]
        live, seated = live[on], new[on]
        tables[live] += 1
    return tables


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens with one end token a text, bounds of the texts)."""
    found, sizes, lo, n = [np.zeros(0, np.uint64)], [], 0, len(offsets) - 1
    while lo < n:  # hashing takes some fifty bytes for each byte of text, so it sees little at a time
        hi = min(max(int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1, lo + 1), n)
        words = Words.of(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        out = np.full(len(words.hashes) + hi - lo, END_HASH, np.uint64)
        out[np.arange(len(words.hashes)) + words.doc] = words.hashes
        found.append(out)
        sizes.append(np.diff(words.bounds) + 1)
        lo = hi
    return np.concatenate(found), np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes])))


def _many_tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens, bounds) in runs of rows of about ``BATCH_BYTES``, split piece by piece."""
    start, size, held = 0, 0, []
    for _, hi, data, offsets in slices(batch, most=PIECE_BYTES):
        held.append(_tokens(data, offsets))
        size += len(data)
        if size > BATCH_BYTES - PIECE_BYTES // 2 or hi == batch.num_rows:
            bounds = np.append(0, np.cumsum(np.concatenate([np.diff(own) for _, own in held])))
            held = [np.concatenate([tokens for tokens, _ in held])]
            yield start, hi, held.pop(), bounds  # the tokens are the receiver's alone
            start, size, held = hi, 0, []


def hot_words(docs: DataFrame, share: float) -> np.ndarray:
    """Sorted hashes of the words (and the end) that make at least ``share`` of all tokens."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch, most=PIECE_BYTES):
                tokens, _ = _tokens(data, offsets)
                words, n = np.unique(tokens, return_counts=True)
                often = 2 * n >= share * len(tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(words[often].view(np.int64), 0)), pa.array(np.append(n[often], len(tokens))),
                     pa.array([False] * int(often.sum()) + [True])], names=["word", "n", "total"])
            give_back()

    seen = materialise(docs.select("text").mapInArrow(count, "word long, n long, total boolean")
                       .groupBy("total", "word").agg(F.sum("n").alias("n")))
    total = seen.filter("total").agg(F.sum("n")).first()[0] or 0
    found = seen.filter(~F.col("total") & (F.col("n") >= share * total)).select("word").collect()  # 1 / share rows at most
    return np.sort(np.array([r["word"] for r in found], np.int64).view(np.uint64))


def _pack(x: np.ndarray) -> bytes:
    """Byte planes of an array, compressed (planes of small numbers are nearly empty)."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(b: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_hashes(x: np.ndarray) -> bytes:
    """Rising hashes as steps."""
    return _pack(np.diff(x, prepend=_U(0)))


def _unpack_hashes(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64, n), dtype=np.uint64)


def _pack_runs(x: np.ndarray) -> bytes:
    """Runs of equal numbers: the first of each run and the runs' lengths."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    runs = _pack(np.diff(np.append(at, len(x))).astype(np.int32))
    return np.array([len(at), len(runs)], np.int64).tobytes() + runs + (_pack_hashes if x.dtype == np.uint64 else _pack)(x[at])


def _unpack_runs(b: bytes, kind) -> np.ndarray:
    n, size = np.frombuffer(b, np.int64, 2)
    first = _unpack_hashes(b[16 + size:], int(n)) if kind == np.uint64 else _unpack(b[16 + size:], kind, int(n))
    return np.repeat(first, _unpack(b[16:16 + size], np.int32, int(n)))


def _pack_steps(x: np.ndarray, below: int) -> bytes:
    """Numbers under ``below`` that mostly rise, as steps modulo ``below``."""
    return _pack((np.diff(x.astype(np.int64), prepend=0) % max(below, 1)).astype(np.int32))


def _unpack_steps(b: bytes, below: int, n: int) -> np.ndarray:
    return np.cumsum(_unpack(b, np.int32, n).astype(np.int64)) % max(below, 1)


def _contexts(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of every token's context: the token before it, or the start."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = START_HASH
    return before


def _pairs(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return mix(words ^ mix(contexts + _U(1)))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted values, first place of each, number of every place's value), as ``np.unique`` in half its memory."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    new = np.append(True, x[1:] != x[:-1])[:len(x)]
    number = np.empty(len(x), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], order[new], number


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    # ranges of the hash: hashes in order are also in order of their shards
    return ((hashes >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _word_keys(words: np.ndarray) -> np.ndarray:
    """Keys of hot words (apart from the same words' keys as contexts)."""
    return mix(words ^ _U(0x9E3779B97F4A7C15))


def _is_in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _keys(words: np.ndarray, contexts: np.ndarray, hot: np.ndarray, shards: int):
    """(keys by shard and hash, their shards, key number of each pair's context, and of its word or -1)."""
    often = _is_in(words, hot)
    keys, number = np.unique(np.concatenate([contexts, _word_keys(words[often])]), return_inverse=True)
    to = _shard(keys, shards)
    order = np.lexsort((keys, to))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    of_word = np.full(len(words), -1, np.int32)
    of_word[often] = place[number[len(contexts):]]
    return keys[order], to[order], place[number[:len(contexts)]], of_word


def _batches(docs: DataFrame, hot: np.ndarray, shards: int) -> DataFrame:
    """Texts as numbered pairs, with the distinct (word, context) pairs in (shard, word, context) order."""
    shared = Shared(docs.sparkSession, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, learn = batch.column(0), np.asarray(batch.column(2))
            for lo, hi, tokens, bounds in _many_tokens(batch):
                context = _contexts(tokens, bounds)
                pair, first, number = _distinct(_pairs(tokens, context))
                taught = np.repeat(learn[lo:hi], np.diff(bounds))
                seen = np.bincount(number[taught], minlength=len(first)).astype(np.int32)
                words, contexts = tokens[first], context[first]
                del tokens, context, taught
                shard = _shard(np.where(_is_in(words, shared.value), pair, words), shards)
                order = np.lexsort((contexts, words, shard))
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order))
                keys, to, of_context, of_word = _keys(words[order], contexts[order], shared.value, shards)
                # a text is the sorted numbers of its pairs (its sums need no order), all texts one rising row
                placed = np.repeat(np.arange(hi - lo) * len(order), np.diff(bounds))
                placed += place[number]
                placed.sort()
                yield pa.RecordBatch.from_arrays([
                    pa.array([part << 32 | seq], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids.slice(lo, hi - lo)),
                    pa.array([np.diff(bounds).tolist()], pa.list_(pa.int64())),
                    pa.array([len(order)], pa.int64()), pa.array([int(seen.sum())], pa.int64()),
                    pa.array([np.bincount(shard, minlength=shards).tolist()], pa.list_(pa.int64())),
                    pa.array([np.bincount(to, minlength=shards).tolist()], pa.list_(pa.int64())),
                    pa.array([_pack_runs(words[order])], pa.binary()), pa.array([_pack_hashes(keys)], pa.binary()),
                    pa.array([_pack_steps(of_context, len(keys))], pa.binary()), pa.array([_pack_runs(of_word)], pa.binary()),
                    pa.array([_pack(seen[order])], pa.binary()),
                    pa.array([_pack(np.diff(placed, prepend=0).astype(np.uint32))], pa.binary()),
                ], names=["batch", "doc_ids", "sizes", "n_pairs", "n_learned", "dealt", "asked", "words", "keys",
                          "of_context", "of_word", "seen", "tokens"])
                seq += 1
                del number, placed
                give_back()

    return materialise(docs.select("doc_id", "text", "learn").mapInArrow(
        run, "batch long, doc_ids array<long>, sizes array<long>, n_pairs long, n_learned long, dealt array<long>, asked array<long>, "
             "words binary, keys binary, of_context binary, of_word binary, seen binary, tokens binary"))


def _cuts(counts: np.ndarray) -> list[tuple[int, slice]]:
    """(number, slice) of every part that is not empty."""
    ends = np.cumsum(counts)
    return [(int(s), slice(ends[s] - counts[s], ends[s])) for s in np.flatnonzero(counts)]


def _deal(batches: DataFrame) -> DataFrame:
    """One row per batch and shard that share words (``contexts`` are numbers into ``known``)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                n, dealt = r["n_pairs"], np.array(r["dealt"])
                words, of_context = _unpack_runs(r["words"], np.uint64), _unpack_steps(r["of_context"], sum(r["asked"]), n)
                keys, seen = _unpack_hashes(r["keys"], sum(r["asked"])), _unpack(r["seen"], np.int32, n)
                rows = []
                for s, c in _cuts(dealt):
                    known, contexts = np.unique(of_context[c], return_inverse=True)
                    rows.append((s, r["batch"], int(dealt[s]), len(known), _pack_runs(words[c]), _pack_hashes(keys[known]),
                                 _pack_steps(contexts, len(known)), _pack(seen[c])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(zip(*rows), [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 4])],
                    names=["shard", "batch", "n", "n_known", "words", "known", "contexts", "seen"])

    return batches.select("batch", "n_pairs", "dealt", "asked", "words", "keys", "of_context", "seen").mapInArrow(
        run, "shard int, batch long, n long, n_known long, words binary, known binary, contexts binary, seen binary")


def seat(c: np.ndarray, word: np.ndarray, context: np.ndarray, word_scale: np.ndarray, context_scale: np.ndarray,
         scale: float, rng: np.random.Generator) -> np.ndarray:
    """Mean tables of every (word, context) pair over the kept sweeps.

    ``word`` and ``context`` number the dishes and restaurants of the pairs. The
    scales take the tables here to those of all shards.
    """
    t, mean = np.minimum(c, 1).astype(np.int64), np.zeros(len(c))
    for sweep in range(DROPPED + KEPT):
        parent = word_scale * np.bincount(word, t, len(word_scale))
        up = np.maximum(parent - DISCOUNT, 0.0) / (THETA + scale * t.sum())
        open_ = context_scale * np.bincount(context, t, len(context_scale))
        t = reseat(c, (THETA + DISCOUNT * open_[context]) * up[word], rng)
        if sweep >= DROPPED:
            mean += t / KEPT
    return mean


class _Part:
    """The distinct pairs of a shard and the keys they need."""

    def __init__(self, pdf: pd.DataFrame, hot: np.ndarray, shards: int):
        pdf = pdf.sort_values("batch")
        self.batches, self.sizes = pdf["batch"].to_numpy(), pdf["n"].to_numpy()
        words = np.concatenate([_unpack_runs(b, np.uint64) for b in pdf["words"]])
        contexts = np.concatenate([_unpack_hashes(k, m)[_unpack_steps(b, m, n)]
                                   for k, m, b, n in zip(pdf["known"], pdf["n_known"], pdf["contexts"], self.sizes)])
        seen = np.concatenate([_unpack(b, np.int32, n) for b, n in zip(pdf["seen"], self.sizes)])
        _, first, self.number = np.unique(_pairs(words, contexts), return_index=True, return_inverse=True)
        self.c = np.bincount(self.number, seen).astype(np.int64)
        words, contexts = words[first], contexts[first]
        self.n_words, self.word = (lambda u: (len(u[0]), u[1]))(np.unique(words, return_inverse=True))
        # keys of learned pairs only: the others have no customers
        taught = self.c > 0
        self.keys, to, of_context, of_word = _keys(words[taught], contexts[taught], hot, shards)
        self.cuts = _cuts(np.bincount(to, minlength=shards))
        self.taught, self.context, self.hot = np.flatnonzero(taught), of_context, of_word

    def by_key(self, x: np.ndarray) -> np.ndarray:
        """Sums of a learned pairs' number by key."""
        often = self.hot >= 0
        return np.bincount(self.context, x, len(self.keys)) + np.bincount(self.hot[often], x[often], len(self.keys))


def _types(dealt: DataFrame, hot: Shared, shards: int) -> DataFrame:
    """Per shard: the exact numbers of distinct learned pairs of its keys, and those of all contexts by key shard."""
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        part, shard = _Part(pdf, hot.value, shards), int(pdf["shard"].iloc[0])
        types, cuts = part.by_key(np.ones(len(part.taught))).astype(np.int32), dict(part.cuts)
        none = slice(0, 0)  # every key shard is asked, so that its total comes back
        return pd.DataFrame([(to, shard, c.stop - c.start, _pack_hashes(part.keys[c]), _pack(types[c]))
                             for to in range(shards) for c in [cuts.get(to, none)]], columns=["to", "shard", "n", "keys", "types"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([_unpack_hashes(b, n) for b, n in zip(pdf["keys"], pdf["n"])])
        types = np.concatenate([_unpack(b, np.int32, n) for b, n in zip(pdf["types"], pdf["n"])])
        found, number = np.unique(keys, return_inverse=True)
        exact = np.bincount(number, types, len(found)).astype(np.int64)
        pairs = int(exact[~_is_in(found, np.sort(_word_keys(hot.value)))].sum())  # a pair has one context
        exact, ends = exact[number], np.cumsum(pdf["n"].to_numpy())
        return pdf[["shard", "to", "n"]].assign(pairs=pairs, types=[_pack(exact[e - n:e]) for e, n in zip(ends, pdf["n"])])

    sent = dealt.groupBy("shard").applyInPandas(count, "to int, shard int, n long, keys binary, types binary")
    return sent.groupBy("to").applyInPandas(add, "shard int, to int, n long, pairs long, types binary")


def _answers(dealt: DataFrame, types: DataFrame, hot: Shared, shards: int, seed: int) -> DataFrame:
    """Per shard: what its pairs' probabilities need per batch, and (batch -1) the sums per key, dealt by key, and the totals."""
    def run(key, pdf: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        part, shard = _Part(pdf, hot.value, shards), int(key[0])
        answered = answered.sort_values("to")
        exact = np.concatenate([np.zeros(0), *[_unpack(b, np.int64, n) for b, n in zip(answered["types"], answered["n"])]])
        scale = exact / np.maximum(part.by_key(np.ones(len(part.taught))), 1)
        word, c, often = part.word[part.taught], part.c[part.taught], part.hot >= 0
        word_scale = np.ones(part.n_words)
        word_scale[word[often]] = scale[part.hot[often]]
        taught = seat(c, word, part.context, word_scale, scale, answered["pairs"].sum() / max(len(c), 1),
                      np.random.default_rng([seed, shard]))
        t = np.zeros(len(part.c))
        t[part.taught] = taught
        total = np.bincount(part.word, part.c, part.n_words).astype(np.int64)
        parent = np.bincount(part.word, t, part.n_words)
        leaf = np.maximum(part.c - DISCOUNT * t, 0.0).astype(np.float32)
        up = np.where(total > 0, np.maximum(parent - DISCOUNT, 0.0), 0.0).astype(np.float32)
        total[word[often]], up[word[often]] = 0, 0.0  # those of hot words come by key
        out, at = [], 0
        for batch, n in zip(part.batches, part.sizes):
            mine = part.number[at:at + n]
            w = part.word[mine]
            out.append((shard, batch, n, _pack(leaf[mine]), _pack_runs(up[w]), _pack_runs(total[w]), -1, None, 0, 0.0))
            at += n
        customers, tables = part.by_key(c).astype(np.int64), np.rint(part.by_key(taught) * KEPT).astype(np.int64)
        for to, cut in part.cuts:
            out.append((shard, -1, cut.stop - cut.start, _pack(customers[cut]), _pack(tables[cut]), None, to,
                        _pack_hashes(part.keys[cut]), 0, 0.0))
        cold = np.setdiff1d(word, word[often])
        out.append((shard, -1, 0, None, None, None, -1, None, len(cold), float(taught.sum())))
        return pd.DataFrame(out, columns=["shard", "batch", "n", "a", "b", "c", "to", "keys", "types", "tables"])

    return materialise(dealt.groupBy("shard").cogroup(types.groupBy("shard")).applyInPandas(
        run, "shard int, batch long, n long, a binary, b binary, c binary, to int, keys binary, types long, tables double"))


def _key_answers(batches: DataFrame, answers: DataFrame, hot: Shared) -> DataFrame:
    """Per key shard: the exact customers and tables of the keys each batch asks for, and (batch -1) its hot words seen."""
    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                asked = np.array(r["asked"])
                keys = _unpack_hashes(r["keys"], int(asked.sum()))
                rows = [(to, r["batch"], int(asked[to]), _pack_hashes(keys[c])) for to, c in _cuts(asked)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(zip(*rows), [pa.int32(), pa.int64(), pa.int64(), pa.binary()])],
                    names=["to", "batch", "n", "keys"])

    def run(key, sums: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        read = lambda name, kind: np.concatenate(
            [np.zeros(0, kind), *[_unpack(b, kind, n) for b, n in zip(sums[name], sums["n"])]])
        keys, number = np.unique(np.concatenate(
            [np.zeros(0, np.uint64), *[_unpack_hashes(b, n) for b, n in zip(sums["keys"], sums["n"])]]), return_inverse=True)
        customers = np.append(np.bincount(number, read("a", np.int64), len(keys)).astype(np.int64), 0)
        tables = np.append(np.bincount(number, read("b", np.int64), len(keys)).astype(np.int64), 0)
        out = [(int(key[0]), -1, 0, None, None, int(_is_in(np.sort(_word_keys(hot.value)), keys).sum()))]
        for batch, n, b in zip(asked["batch"], asked["n"], asked["keys"]):
            x = _unpack_hashes(b, n)
            at = np.where(_is_in(x, keys), np.searchsorted(keys, x), len(keys))
            out.append((int(key[0]), batch, n, _pack(customers[at]), _pack(tables[at]), 0))
        return pd.DataFrame(out, columns=["shard", "batch", "n", "a", "b", "types"])

    requests = batches.select("batch", "asked", "keys").mapInArrow(ask, "to int, batch long, n long, keys binary")
    sums = answers.filter("to >= 0").select("to", "n", "a", "b", "keys")
    return materialise(sums.groupBy("to").cogroup(requests.groupBy("to")).applyInPandas(
        run, "shard int, batch long, n long, a binary, b binary, types long"))


def score(docs: DataFrame, *, shards: int | None = None, seed: int = 1) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``docs`` has doc_id, text and ``learn`` (rows to learn from). ``base_score``
    is the add-one unigram log10 probability, ``score`` the model's. ``shards``
    deals the vocabulary; by default the session's shuffle partitions.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce("learn", F.lit(False)).alias("learn"))
    words = hot_words(docs, 1 / (4 * shards))
    hot = Shared(spark, words)
    batches = _batches(docs, words, shards)
    dealt = _deal(batches)
    answers = _answers(dealt, _types(dealt, hot, shards), hot, shards, seed)
    del dealt  # its shuffle can go before the next one is written
    key_answers = _key_answers(batches, answers, hot)
    learned = batches.agg(F.sum("n_learned")).first()[0] or 0
    whole = answers.filter("batch = -1").agg(F.sum("types").alias("types"), F.sum("tables").alias("tables")).first()
    types, tables = whole["types"] or 0, whole["tables"] or 0.0
    types += key_answers.filter("batch = -1").agg(F.sum("types")).first()[0] or 0
    release(spark)

    def finish(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r, right = left.iloc[0], right.sort_values("shard")
        read = lambda of, name, kind: np.concatenate([_unpack(b, kind, n) for b, n in zip(of[name], of["n"])])
        pairs, keys = right[~right["key"]], right[right["key"]]
        leaf = read(pairs, "a", np.float32).astype(float)
        up = np.concatenate([_unpack_runs(b, np.float32) for b in pairs["b"]]).astype(float)
        total = np.concatenate([_unpack_runs(b, np.int64) for b in pairs["c"]])
        customers, open_ = read(keys, "a", np.int64), read(keys, "b", np.int64) / KEPT
        context, hot_word = _unpack_steps(r["of_context"], len(customers), r["n_pairs"]), _unpack_runs(r["of_word"], np.int32)
        often = hot_word >= 0
        total[often] = customers[hot_word[often]]
        up[often] = np.maximum(open_[hot_word[often]] - DISCOUNT, 0.0)
        sizes = np.asarray(r["sizes"], np.int64)
        number = np.cumsum(_unpack(r["tokens"], np.uint32, int(sizes.sum())), dtype=np.int64)
        number -= np.repeat(np.arange(len(sizes)) * r["n_pairs"], sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        parent = np.where(total > 0, up, THETA + DISCOUNT * types) / (THETA + tables)
        p = (leaf + (THETA + DISCOUNT * open_[context]) * parent) / (THETA + customers[context])
        lg = np.log10(p)
        base = np.log10(total + 1.0) - math.log10(learned + types + 1.0)
        add = lambda x: np.bincount(doc, x[number], len(sizes))
        out = pd.DataFrame({"doc_id": pd.array(list(r["doc_ids"]), dtype="Int64"), "n_tokens": sizes,
                            "n_known": add((total > 0).astype(np.float64)).astype(np.int64), "train_tokens": learned,
                            "base_score": add(base), "score": add(lg)})
        del doc, number, leaf, up, total, customers, open_, context, hot_word, often, parent, p, lg, base
        give_back()
        return out

    cols = batches.select("batch", "doc_ids", "sizes", "n_pairs", "of_context", "of_word", "tokens")
    mine = (answers.filter("batch >= 0").select("shard", "batch", "n", "a", "b", "c", F.lit(False).alias("key"))
            .unionByName(key_answers.filter("batch >= 0").select(
                "shard", "batch", "n", "a", "b", F.lit(None).cast("binary").alias("c"), F.lit(True).alias("key"))))
    return cols.groupBy("batch").cogroup(mine.groupBy("batch")).applyInPandas(
        finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
