"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut by the tokenizer's pattern; every distinct piece is encoded
once per task and remembered. New pieces are encoded together: they are put
into length buckets, each bucket is a padded matrix of byte ranks, and in a
round every row merges its leftmost pair of minimum rank, found through a
hashed pair table, and is compacted by one place. Rows without a mergeable
pair leave the matrix. Pieces longer than ``LONGEST`` bytes are merged with a
heap instead (same order: lowest rank, then leftmost), so that a piece of any
length costs n log n.

Encoding is one narrow pass without a shuffle; decoding gathers bytes by id.

Edge cases: null and empty texts encode to no ids and decode to no bytes.
Ids outside the vocabulary raise an error when decoding. The rank file is a
parameter and is read on the driver, once per job, and sent to the tasks.
Extra columns are kept; columns with the names that an operator adds are
replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Shared

LONGEST = 1024
#: Pieces remembered per task before the memory is emptied.
REMEMBERED = 100_000
#: Characters of text whose pieces are encoded together.
GROUP_CHARS = 1 << 18
_U = np.uint64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Open-addressing hash table (left id, right id) -> merged id, with vectorised lookup."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = np.array(left, np.uint64) << _U(32) | np.array(right, np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, np.iinfo(np.int32).max, np.int32)
        place, todo = self._place(keys), np.arange(len(keys))
        self.probes = 1
        while len(todo):
            free = self.keys[place[todo]] == np.iinfo(np.uint64).max
            at, first = np.unique(place[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[at], self.values[at] = keys[won], np.array(merged, np.int32)[won]
            todo = np.setdiff1d(todo, won)
            place[todo] = (place[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(todo))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; the largest int32 where a pair has none (or an id is -1)."""
        none = np.iinfo(np.int32).max
        keys = left.astype(np.uint64) << _U(32) | (right.astype(np.uint64) & _U(0xFFFFFFFF))
        at = self._place(keys)
        out = np.where(self.keys[at] == keys, self.values[at], none)
        miss = np.flatnonzero((out == none) & (self.keys[at] != np.iinfo(np.uint64).max) & (right >= 0))
        for _ in range(self.probes):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[miss]]
            hit = got == keys[miss]
            out[miss[hit]] = self.values[at[miss[hit]]]
            miss = miss[~hit & (got != np.iinfo(np.uint64).max)]
        out[right < 0] = none
        return out


@dataclass
class Bpe:
    """A byte-level BPE vocabulary with its lookup tables."""

    ranks: dict[bytes, int]
    pattern: str
    _known: dict[str, tuple[bytes, str]] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(self.ranks)
        size = max(self.ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in self.ranks.items():
            lengths[rank] = len(token)
        self.lengths, self.at = lengths, np.cumsum(lengths) - lengths
        self.flat = np.zeros(int(lengths.sum()), np.uint8)
        for token, rank in self.ranks.items():
            self.flat[self.at[rank]:self.at[rank] + len(token)] = np.frombuffer(token, np.uint8)
        self._split = None

    def __getstate__(self):
        return self.__dict__ | {"_split": None, "_known": {}}

    def split(self, text: str) -> list[str]:
        if self._split is None:
            import regex
            self._split = regex.compile(self.pattern).findall
        return self._split(text)

    # pieces -----------------------------------------------------------------

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of every piece; rows of similar length share a padded matrix."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > LONGEST:
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 19) // width)
            for lo in range(0, len(rows), step):
                for i, ids in zip(rows[lo:lo + step], self._merge_matrix([pieces[i] for i in rows[lo:lo + step]], width)):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        none = np.iinfo(np.int32).max
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        filled = np.arange(width) < lengths[:, None]
        m = np.full((len(pieces), width + 1), -1, np.int32)  # one spare column stays -1
        m[:, :width][filled] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        done: list[np.ndarray | None] = [None] * len(pieces)
        row = np.arange(len(pieces))
        rank = self.pairs.find(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(pieces), width)
        while len(row):
            best = rank.argmin(1)  # the first of equal minima: leftmost
            merged = rank[np.arange(len(row)), best]
            ended = merged == none
            if ended.any():
                for j in np.flatnonzero(ended):
                    done[row[j]] = m[j, :lengths[row[j]]].copy()
                live = ~ended
                row, m, rank, best, merged = row[live], m[live], rank[live], best[live], merged[live]
                if not len(row):
                    break
            n = np.arange(len(row))
            m[n, best] = merged
            # compaction: everything right of the merged pair moves one place left
            col = np.arange(m.shape[1] - 1)
            take = col + (col > best[:, None])
            m[:, :-1] = np.take_along_axis(m, take, 1)
            m[:, -1] = -1
            lengths[row] -= 1
            moved = np.take_along_axis(rank, np.minimum(take, rank.shape[1] - 1), 1)
            moved[:, -1] = none
            rank = moved
            rank[n, best] = self.pairs.find(merged, m[n, best + 1])
            has_left = best > 0
            rank[n[has_left], best[has_left] - 1] = self.pairs.find(m[n[has_left], best[has_left] - 1], merged[has_left])
            widest = int(lengths[row].max())
            if widest * 2 <= rank.shape[1]:
                m, rank = m[:, :widest + 1].copy(), rank[:, :widest].copy()
        return done

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        none = np.iinfo(np.int32).max
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != none]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = nxt[i]
            if i < 0 or j >= n:
                return
            key = (ids[i], ids[j])
            if key not in known:
                known[key] = int(self.pairs.find(np.array([key[0]]), np.array([key[1]]))[0])
            if known[key] != none:
                heapq.heappush(heap, (known[key], i, *key))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    # texts ------------------------------------------------------------------

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self._known]
        if len(self._known) + len(new) > REMEMBERED:
            self._known.clear()
            new = list(pieces)
        for piece, ids in zip(new, self.encode_pieces([p.encode() for p in new])):
            self._known[piece] = (ids.tobytes(), " ".join(map(str, ids.tolist())))  # bytes: a third of an array's memory

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """(ids, ids as decimal text) of every text, in order."""
        lo = 0
        while lo < len(texts):
            cut, size, hi = [], 0, lo
            while hi < len(texts) and (hi == lo or size < GROUP_CHARS):
                cut.append(self.split(texts[hi]) if texts[hi] else [])
                size += len(texts[hi] or "")
                hi += 1
            self._learn(set().union(*cut))
            for pieces in cut:
                found = [self._known[p] for p in pieces]
                yield np.frombuffer(b"".join([x[0] for x in found]), np.int32), " ".join([x[1] for x in found])
            lo = hi

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = np.arange(int(end[-1]) if len(ids) else 0) + np.repeat(self.at[ids] - (end - size), size)
        return self.flat[at].tobytes()


def _with(docs: DataFrame, added: T.StructType, column: str, per_batch) -> DataFrame:
    """``docs`` plus the columns that ``per_batch`` makes of ``column``'s values."""
    kept = [f for f in docs.schema.fields if f.name not in added.names]
    if column in added.names:
        kept = [f for f in docs.schema.fields if f.name not in set(added.names) - {column}]
    names = [f.name for f in kept if f.name != column or column not in added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # few texts at a time: the tasks of an executor share its memory with the JVM
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                values = part.column(part.schema.get_field_index(column))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(n)) for n in names] + per_batch(values),
                    names=names + added.names)

    out = T.StructType([f for f in kept if f.name in names] + added.fields)
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, out)


def encode(docs: DataFrame, bpe: Bpe, *, text: str = "text", ids: str = "ids", digest: str | None = None) -> DataFrame:
    """Add ``ids`` (array of int); with ``digest`` also the SHA-256 of the ids' decimal text."""
    shared = Shared(docs.sparkSession, bpe)
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if digest:
        added.append(T.StructField(digest, T.StringType(), False))

    def per_batch(values: pa.Array) -> list[pa.Array]:
        arrays, sums = [], []
        for found, as_text in shared.value.encode_batch(values.to_pylist()):
            arrays.append(found)
            sums.append(hashlib.sha256(as_text.encode()).hexdigest() if digest else None)
        ends = np.cumsum([0, *map(len, arrays)])
        flat = pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32())
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)] + ([pa.array(sums)] if digest else [])

    return _with(docs, T.StructType(added), text, per_batch)


def decode(rows: DataFrame, bpe: Bpe, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the bytes of the ids (null ids: no bytes)."""
    shared = Shared(rows.sparkSession, bpe)

    def per_batch(values: pa.Array) -> list[pa.Array]:
        offsets = np.asarray(values.offsets)
        flat = values.values.to_numpy(zero_copy_only=False)
        valid = np.asarray(values.is_valid())
        return [pa.array([shared.value.decode(flat[offsets[i]:offsets[i + 1]] if valid[i] else [])
                          for i in range(len(values))], pa.binary())]

    return _with(rows, T.StructType([T.StructField(decoded, T.BinaryType(), False)]), ids, per_batch)
