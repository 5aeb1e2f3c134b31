"""Cross-tokenizer alignment with an identity-map fast path.

A text is encoded by a byte-level BPE (A: a space and the text) and by a
sentence-piece model (B: it adds the space itself). Byte offsets where tokens
of both end cut the tokens into groups; a link is an occurrence of an A and a
B token whose byte ranges overlap. Every stretch between two neighbouring
ends (of either side) belongs to exactly one link, so links are counted by
merging the two lists of ends.

1. **Identity map.** A table from A id to the B id of the same bytes is
   computed once from the two vocabularies. A group of one A token and the B
   token that the table names is *regular*; a task counts its regular groups
   in a vector as long as A's vocabulary, whatever the number of texts.
2. **Irregular groups** give pairs (a, b). A block of texts (about
   ``block_bytes``) lists its distinct pairs once, with counts; only these
   lists enter the pair shuffle, so a pair that makes up a third of all links
   still has one row a block. Regular totals join them by pair.
3. The largest count of each B id is one row an id of B's vocabulary and is
   broadcast; a block gets the counts of its own pairs back, and the totals of
   the identity pairs are a vector as long as A's vocabulary. Texts are
   encoded once: a text's links travel as numbers of its block's pair list.

Tokens never reach from a word over the space after it, so a text is cut at
such spaces, and a distinct piece is encoded once by the two libraries (new
pieces are joined by spaces to texts of ``_JOINED`` and cut again) and
remembered by the Python worker (at most twice ``REMEMBERED`` pieces). Vocabularies
with other pre-tokenisation, normalisation or pieces get whole texts.

Edge cases: a text that is null or empty, or whose joined A or B bytes differ
from the space and the text (normalised or unknown characters), has no
tokens: zeros and an empty digest. Repeated rows and rows without doc_id each
count. Ties: every pair whose count is its B id's largest is a best one. An
empty table gives no rows and no pairs. A text longer than a block is a block
of its own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Shared, stored

_DOC, _PAIRS, _REGULAR = 0, 1, 2
#: Texts that the tokenizers get at once hold about so many characters.
_ENCODE_CHARS = 1 << 18
#: Pieces remembered by a Python worker, and as many older ones; longer ones are encoded each time.
REMEMBERED = 100_000
_LONGEST = 64
#: New pieces that the tokenizers get as one text (with spaces between them, where it is cut again); so few go one by one.
_JOINED = 64
#: A space after a word. A space after white space begins no piece.
_cut = re.compile(r" (?<=\S )").split
_SCHEMA = ("kind byte, part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "n_regular long, links binary, keys array<long>, counts array<long>")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """The two tokenizers, the bytes of their ids and the identity map."""

    def __init__(self, a_json: str, b_model: bytes):
        import os

        from sentencepiece import SentencePieceProcessor
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        added = {k: v.content for k, v in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = token.encode() if i in added else bytes(alphabet[c] for c in token)
        n_b = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(n_b)))]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # a whole piece goes before a byte piece, then the smallest id
        same = {}
        for i in sorted(range(n_b), key=lambda i: (self.b.is_byte(i), i)):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                same.setdefault(self.bytes_b[i], i)
        self.identity = np.array([same.get(x, -1) for x in self.bytes_a], np.int64)
        self._known: dict[str, tuple[bytes, bytes] | None] = {}
        self._older: dict[str, tuple[bytes, bytes] | None] = {}
        self.by_piece = _cuts_at_spaces(json.loads(a_json)) and _joins_no_words(b_model)
        # decimal ids followed by each separator, for the digests
        width = len(str(max(len(self.bytes_a), n_b))) + 1
        self.written = np.array([f"{i}{s}" for n, seps in ((len(self.bytes_a), ",|"), (n_b, ",;")) for s in seps
                                 for i in range(n)], f"S{width}")

    def encode(self, texts: list[str | None]) -> tuple[list[bool], list[np.ndarray], list[np.ndarray]]:
        """(has tokens, A ids, B ids) of every text; ids only of the texts that have tokens."""
        cut = [(_cut(t) if self.by_piece else [t]) if t else [] for t in texts]
        passing = self._learn(set().union(*cut))
        valid, ids_a, ids_b = [], [], []
        for pieces in cut:
            found = [self._known[p] for p in pieces]
            valid.append(bool(found) and None not in found)
            if valid[-1]:
                ids_a.append(np.frombuffer(b"".join([a for a, _ in found]), np.int32))
                ids_b.append(np.frombuffer(b"".join([b for _, b in found]), np.int32))
        for p in passing:
            del self._known[p]
        return valid, ids_a, ids_b

    def _learn(self, pieces: set[str]) -> list[str]:
        """Ids of new pieces, None where the bytes differ; returns the pieces that are too long to be kept.

        Pieces used since the memory was last full are kept when it is full again.
        """
        new = []
        if len(self._known) + len(pieces) > REMEMBERED:
            self._older, self._known = self._known, {}
        for p in pieces:
            if p not in self._known:
                if p in self._older:
                    self._known[p] = self._older[p]
                else:
                    new.append(p)
        if not new:
            return []
        plain, alone = [], []
        for p in new:  # a space after white space would begin no piece
            (plain if self.by_piece and p and len(p) <= _LONGEST and not p[-1].isspace() and "▁" not in p else alone).append(p)
        if len(plain) <= _JOINED or not self._learn_joined(plain):
            alone = new
        if alone:
            self._learn_alone(alone)
        return [p for p in new if len(p) > _LONGEST]

    def _learn_joined(self, new: list[str]) -> bool:
        """Ids of pieces that are encoded many at once as one text; False (and nothing learned) where any bytes differ."""
        texts = [" ".join(new[lo:lo + _JOINED]) for lo in range(0, len(new), _JOINED)]
        found_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        found_b = self.b.encode(texts, num_threads=1)
        wanted = (" " + " ".join(new)).encode()
        ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in new), np.int64, len(new)))
        packed = []
        for found, of, lengths in ((found_a, self.bytes_a, self.len_a), (found_b, self.bytes_b, self.len_b)):
            ids = np.fromiter(chain.from_iterable(found), np.int32)
            reached = np.cumsum(lengths[ids])
            at = np.searchsorted(reached, ends)
            if at[-1] != len(ids) - 1 or not (reached[at] == ends).all() or b"".join(map(of.__getitem__, ids.tolist())) != wanted:
                return False
            flat, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
            packed.append([flat[lo:hi] for lo, hi in zip([0, *cuts], cuts)])
        self._known.update(zip(new, zip(*packed)))
        return True

    def _learn_alone(self, new: list[str]) -> None:
        """Ids of pieces that are encoded one by one, None where the bytes differ."""
        found_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in new], add_special_tokens=False)]
        # a last space is an empty piece, for which the library gives nothing
        found_b = [b if p else [self.b.piece_to_id("▁")] for p, b in zip(new, self.b.encode(new, num_threads=1))]
        wanted = [b" " + p.encode() for p in new]
        long = np.fromiter(map(len, wanted), np.int64, len(new))
        same, packed = np.ones(len(new), bool), []
        for found, of, lengths in ((found_a, self.bytes_a, self.len_a), (found_b, self.bytes_b, self.len_b)):
            sizes = np.fromiter(map(len, found), np.int64, len(new))
            ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
            got = np.bincount(np.repeat(np.arange(len(new)), sizes), lengths[ids], len(new)).astype(np.int64)
            if not (got == long).all() or b"".join(map(of.__getitem__, ids.tolist())) != b"".join(wanted):
                same &= [b"".join(map(of.__getitem__, x)) == w for x, w in zip(found, wanted)]
            flat, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
            packed.append([flat[lo:hi] for lo, hi in zip([0, *ends], ends)])
        for p, ok, a, b in zip(new, same.tolist(), *packed):
            self._known[p] = (a, b) if ok else None


def _cuts_at_spaces(a: dict) -> bool:
    """Whether a byte-level BPE looks at the pieces before each space that follows a word separately."""
    pre = a.get("pre_tokenizer") or {}
    return (not any(a.get(k) for k in ("normalizer", "truncation", "padding")) and a["model"].get("type") == "BPE"
            and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space")
            and all(t.get("special") for t in a.get("added_tokens", ())))


def _joins_no_words(b_model: bytes) -> bool:
    """Whether a sentence-piece BPE takes the text as it is and has no piece with a space after another character."""
    from sentencepiece import sentencepiece_model_pb2
    m = sentencepiece_model_pb2.ModelProto.FromString(b_model)
    plain = m.normalizer_spec
    return (m.trainer_spec.model_type == m.trainer_spec.BPE and m.trainer_spec.byte_fallback and not plain.precompiled_charsmap
            and plain.add_dummy_prefix and not plain.remove_extra_whitespaces and plain.escape_whitespaces
            and not m.trainer_spec.treat_whitespace_as_suffix
            and any(p.piece == "▁" for p in m.pieces)
            and all(p.type in (p.NORMAL, p.UNKNOWN, p.CONTROL, p.BYTE) and "▁" not in p.piece.lstrip("▁") for p in m.pieces))


class Aligned:
    """Links and groups of some texts (all with tokens), computed together."""

    def __init__(self, tok: Tokenizers, ids_a: list[np.ndarray], ids_b: list[np.ndarray]):
        self.n_a = np.array([len(x) for x in ids_a], np.int64)
        self.n_b = np.array([len(x) for x in ids_b], np.int64)
        a = np.concatenate([np.zeros(0, np.int64), *ids_a])
        b = np.concatenate([np.zeros(0, np.int64), *ids_b])
        ends_a, ends_b = np.cumsum(tok.len_a[a]), np.cumsum(tok.len_b[b])
        size = int(ends_a[-1]) + 1 if len(a) else 1
        in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
        in_a[ends_a] = True
        in_b[ends_b] = True
        seg = np.flatnonzero(in_a | in_b)
        at_a, at_b = in_a[seg], in_b[seg]
        self.link_a = a[np.cumsum(at_a) - at_a]
        self.link_b = b[np.cumsum(at_b) - at_b]
        common = at_a & at_b
        alone = common.copy()
        alone[1:] &= common[:-1]
        self.regular = alone & (tok.identity[self.link_a] == self.link_b)
        last_a = np.cumsum(self.n_a)
        self.link_ends = np.searchsorted(seg, ends_a[last_a - 1], "right") if len(last_a) else last_a
        # common ends of each text
        upto = np.concatenate([[0], np.cumsum(common)])
        starts = np.concatenate([[0], self.link_ends[:-1]]) if len(last_a) else last_a
        self.n_groups = upto[self.link_ends] - upto[starts]
        self.link_starts = starts
        # a group's A tokens, then its B tokens
        group = upto[:-1]
        own_a, own_b = np.flatnonzero(at_a), np.flatnonzero(at_b)  # the stretch that each token ends with
        group_a, group_b = group[own_a], group[own_b]
        per_a, per_b = np.bincount(group_a, minlength=int(common.sum())), np.bincount(group_b, minlength=int(common.sum()))
        before_b, upto_a = np.cumsum(per_b) - per_b, np.cumsum(per_a)
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + before_b[group_a]] = a + len(tok.bytes_a) * common[own_a]
        line[np.arange(len(b)) + upto_a[group_b]] = 2 * len(tok.bytes_a) + b + len(tok.bytes_b) * common[own_b]
        cells = tok.written[line].view(np.uint8).reshape(len(line), tok.written.itemsize)
        used = cells != 0
        self._flat = cells[used].tobytes()
        sizes = np.cumsum(used.sum(1))
        self._text_ends = sizes[np.cumsum(self.n_a + self.n_b) - 1] if len(last_a) else last_a

    def digests(self) -> list[str]:
        starts = [0, *self._text_ends[:-1].tolist()]
        return [hashlib.sha256(self._flat[lo:hi - 1]).hexdigest() for lo, hi in zip(starts, self._text_ends.tolist())]


def _pack(numbers: np.ndarray) -> bytes:
    """Compressed numbers below 2^32, byte planes apart (the upper ones are nearly constant)."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and size + n > _ENCODE_CHARS:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def _blocks(sent, block_bytes: int):
    """Function over Arrow batches of (doc_id, text): rows of ``_SCHEMA``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held = sent.value
        if held.built is None:  # the broadcast object lives as long as the Python worker
            held.built = Tokenizers(held.a_json, held.b_model)
        tok: Tokenizers = held.built
        regular_counts = np.zeros(len(tok.bytes_a), np.int64)
        schema = pa.schema([("kind", pa.int8()), ("part", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
                            ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                            ("groups_sha256", pa.string()), ("n_regular", pa.int64()), ("links", pa.binary()),
                            ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
        part = TaskContext.get().partitionId() << 32
        rows, size = [], 0

        def listed(kind: int, keys: np.ndarray, counts: np.ndarray) -> dict:
            return {"kind": kind, "part": part, "keys": keys, "counts": counts}

        def flush() -> pa.RecordBatch:
            nonlocal rows, size, part
            irregular = [r.pop("irregular") for r in rows]
            keys, number, counts = np.unique(np.concatenate(irregular), return_inverse=True, return_counts=True)
            ends = np.cumsum([len(x) for x in irregular])
            for r, own in zip(rows, np.split(number, ends[:-1])):
                r["links"] = _pack(np.concatenate([r.pop("regular"), own]))
            out = pa.RecordBatch.from_pylist([*rows, listed(_PAIRS, keys, counts)], schema)
            part, rows, size = part + 1, [], 0
            return out

        none = np.zeros(0, np.int64)
        for part_of in (batch.slice(lo, 256) for batch in batches for lo in range(0, batch.num_rows, 256)):
            ids, texts = part_of.column(0).to_pylist(), part_of.column(1).to_pylist()
            for lo, hi in _slices(texts):
                valid, ids_a, ids_b = tok.encode(texts[lo:hi])
                got = Aligned(tok, ids_a, ids_b)
                regular_counts += np.bincount(got.link_a[got.regular], minlength=len(regular_counts))
                key = (got.link_a << 32) | got.link_b
                digests = got.digests()
                k = 0
                for doc_id, text, ok in zip(ids[lo:hi], texts[lo:hi], valid):
                    row = {"kind": _DOC, "part": part, "doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0,
                           "groups_sha256": "", "n_regular": 0, "regular": none, "irregular": none}
                    if ok:
                        span = slice(got.link_starts[k], got.link_ends[k])
                        own = got.regular[span]
                        row |= {"n_a": got.n_a[k], "n_b": got.n_b[k], "n_groups": got.n_groups[k], "n_links": len(own),
                                "groups_sha256": digests[k], "n_regular": int(own.sum()),
                                "regular": got.link_a[span][own], "irregular": key[span][~own]}
                        k += 1
                    rows.append(row)
                    size += len(text or "")
                    if size >= block_bytes:
                        yield flush()
        if rows:
            yield flush()
        seen = np.flatnonzero(regular_counts)
        keys = (seen << 32) | tok.identity[seen]
        yield pa.RecordBatch.from_pylist([listed(_REGULAR, keys, regular_counts[seen])], schema)
    return run


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((part, i, key) of the blocks' pair lists, (key, regular, n, best) of all pairs); key = a * 2^32 + b."""
    lists = blocks.filter(F.col("kind") == _PAIRS).select("part", F.posexplode(F.arrays_zip("keys", "counts")).alias("i", "p"))
    pairs = lists.select("part", "i", F.col("p.keys").alias("key"), F.col("p.counts").alias("n"))
    regular = blocks.filter(F.col("kind") == _REGULAR).select(F.explode(F.arrays_zip("keys", "counts")).alias("p"))
    totals = stored(pairs.select("key", "n", F.lit(0).alias("r"))
                    .unionByName(regular.select(F.col("p.keys").alias("key"), F.col("p.counts").alias("n"), F.lit(1).alias("r")))
                    .groupBy("key").agg(F.sum("n").alias("n"), F.max("r").alias("regular")))
    b = F.col("key").bitwiseAND((1 << 32) - 1)
    best = totals.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # one row an id of B's vocabulary
    marked = totals.withColumn("b", b).join(F.broadcast(best), "b").select("key", "regular", "n", (F.col("n") == F.col("most")).alias("best"))
    return pairs.select("part", "i", "key"), marked


def align(docs: DataFrame, a_json: str, b_model: bytes, *, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    ``a_json`` is the content of a byte-level BPE file of the ``tokenizers``
    library, ``b_model`` that of a ``sentencepiece`` model.
    """
    blocks, pairs, marked = _aligned(docs, a_json, b_model, block_bytes)
    answers = pairs.join(marked, "key").select(F.col("part").alias("block"), "i", "n", "best")
    # one row an id of A's vocabulary at most
    known = [(r["key"] >> 32, r["n"], r["best"]) for r in marked.filter("regular = 1").select("key", "n", "best").collect()]
    size = 1 + max((a for a, _, _ in known), default=0)
    totals, bests = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for a, n, best in known:
        totals[a], bests[a] = n, best
    vector = Shared(docs.sparkSession, (totals, bests))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def finish(key, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        regular_n, regular_best = vector.value
        n, best = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        n[found["i"].to_numpy()] = found["n"]
        best[found["i"].to_numpy()] = found["best"]
        sums, bests_ = [], []
        for packed, cut in zip(texts["links"], texts["n_regular"]):
            numbers = _unpack(packed)
            a, i = numbers[:cut], numbers[cut:]
            sums.append(int(regular_n[a].sum() + n[i].sum()))
            bests_.append(int(regular_best[a].sum() + best[i].sum()))
        return texts[columns].assign(n_best=bests_, count_sum=sums, groups_sha256=texts["groups_sha256"])

    rows = blocks.filter(F.col("kind") == _DOC).select("part", *columns, "groups_sha256", "n_regular", "links")
    return rows.groupBy("part").cogroup(answers.groupBy("block")).applyInPandas(
        finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _aligned(docs: DataFrame, a_json: str, b_model: bytes, block_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    sent = docs.sparkSession.sparkContext.broadcast(SimpleNamespace(a_json=a_json, b_model=b_model, built=None))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = stored(rows.mapInArrow(_blocks(sent, block_bytes), _SCHEMA))
    return blocks, *pair_counts(blocks)


def pair_table(docs: DataFrame, a_json: str, b_model: bytes, *, block_bytes: int = 8 << 20) -> DataFrame:
    """(a, b, n, same_bytes, best): how many links of the corpus hold each id pair; ``best`` for B's most frequent partners."""
    _, _, marked = _aligned(docs, a_json, b_model, block_bytes)
    return marked.select(F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND((1 << 32) - 1).cast("int").alias("b"),
                         "n", (F.col("regular") == 1).alias("same_bytes"), "best")
