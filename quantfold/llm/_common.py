"""Shared pieces of the training-data operators.

* ``materialise`` cuts lineage in the folder named by ``spark.checkpoint.dir``.
* ``slices`` walks Arrow batches in pieces of bounded text size.
* ``Words`` splits a piece into words with numpy and hashes them.
* ``components`` labels connected components of an edge table.
"""

from __future__ import annotations

import ctypes
import gc
import itertools
import time
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

#: Java pattern of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that one numpy step looks at (a longer document is one step).
SLICE_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_released = 0.0


def release(spark: SparkSession, after: float = 0.0) -> None:
    """Let Spark delete what no table in use needs any more, unless that was done less than ``after`` seconds ago.

    Shuffle files and checkpoints are deleted once the driver has collected
    the objects that stand for them. A driver with a quiet heap does so
    seldom, and long jobs keep every stage's files until then. The scheduler
    remembers the last job, so a job of one row comes between two collections,
    and Spark's cleaner gets a moment.
    """
    global _released
    if time.monotonic() - _released < after:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)
    spark.range(0, 1, 1, 1).collect()
    spark.sparkContext._jvm.System.gc()
    _released = time.monotonic()


def materialise(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder; earlier tables out of use are released first."""
    release(df.sparkSession, after=5.0)
    return cut_lineage(df)


def give_back() -> None:
    """Return freed memory to the system, where the C library can.

    Idle Python workers wait a minute for the next task; what the allocators
    keep for them until then is missing to the JVM of the same executor.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Shared:
    """A broadcast Python object, sent with its class and unpacked once a task."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_sent": self._sent, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._sent.value)
        return self._value


#: Rows of a few numbers that may be broadcast; larger tables take a shuffled join.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when it is counted to be small (``df`` is materialised)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the engine's fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (every output bit depends on every input bit)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls read as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    offsets = np.frombuffer(offs, dtype=kind, count=len(column) + 1,
                            offset=column.offset * kind.itemsize).astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) in runs of rows of about ``most`` bytes."""
    if batch.num_rows == 0:
        return
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    """The words of some documents: byte spans, document numbers and hashes.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the A-Z-lower-cased bytes. A hash is
    a 64-bit polynomial of the word's bytes, finalised with its length.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # words of document i are bounds[i]:bounds[i + 1]

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        data = _LOWER[data]
        n_docs = len(offsets) - 1
        if len(data) == 0:
            none = np.zeros(0, np.int64)
            return cls(data, none, none, none, np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64))
        space = _IS_SPACE[data]
        filled = offsets[:-1] < offsets[1:]
        before = np.empty(len(data), bool)
        before[1:] = space[:-1]
        before[offsets[:-1][filled]] = True
        after = np.empty(len(data), bool)
        after[:-1] = space[1:]
        after[offsets[1:][filled] - 1] = True
        starts = np.flatnonzero(before & ~space)
        ends = np.flatnonzero(after & ~space) + 1
        bounds = np.searchsorted(starts, offsets)
        doc = np.repeat(np.arange(n_docs), np.diff(bounds))
        power = np.full(len(data), _BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * power, out=sums[1:])
        inverse = np.full(len(data), _BASE_INV, np.uint64)
        inverse[0] = 1
        np.cumprod(inverse, out=inverse)
        raw = (sums[ends] - sums[starts]) * inverse[starts]
        return cls(data, starts, ends, doc, mix(raw + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)), bounds)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words; the whole sequence where it is shorter."""
    if len(words) == 0:
        return words
    size_here = min(size, len(words))
    out = np.full(len(words) - size_here + 1, size_here, np.uint64)
    for k in range(size_here):
        out = out * _U(0xFF51AFD7ED558CCD) + words[k:len(words) - size_here + 1 + k]
        out ^= out >> _U(29)
    return mix(out)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from every node of ``edges``.

    Labels are passed along the edges and then followed once (label of the
    label) until nothing changes, so long chains shorten geometrically. Each
    round's labels are written and read again, which also gives them the size
    of their files: a checkpoint keeps the planner's estimate, a product of
    the sizes of all joined tables, whose number of digits would grow some
    threefold a round until it fills the driver. Earlier rounds are deleted.
    Work per round is one pass over the edges; a node with very many edges is
    pre-aggregated (``min``) before the shuffle. The labels are broadcast when
    there are at most ``BROADCAST_ROWS`` nodes.
    """
    both = materialise(edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
                       .unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst")))
                       .filter("src <> dst").distinct())
    place = _folder(edges.sparkSession)
    path = f"{place}/0"
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
                    .select("node", F.least("node", "m").alias("component")), path)
    few = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # holds for every round: the nodes stay
    sent = F.broadcast if few else (lambda t: t)
    for step in itertools.count(1):
        heard = both.join(sent(labels), F.col("src") == F.col("node")).select(
            F.col("dst").alias("node"), "component", F.lit(None).cast("long").alias("was"))
        near = (heard.unionByName(labels.select("node", "component", F.col("component").alias("was")))
                .groupBy("node").agg(F.min("component").alias("near"), F.max("was").alias("was")))
        up = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        earlier, path = path, f"{place}/{step}"
        new = stored(near.join(sent(up), "near").select("node", "was", F.least("near", "far").alias("component")), path)
        _delete(edges.sparkSession, earlier)
        changed = new.filter("component <> was").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels


def _folder(spark: SparkSession) -> str:
    """A new path below the shared checkpoint folder; what is written there goes when the session's file system is closed."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quantfold-{uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)  # only what exists can be marked
    files.deleteOnExit(where)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, path: str = "") -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder (or to ``path`` in it) and read back.

    For large intermediates: columnar, compressed, and read by column. The
    folder goes when the session's file system is closed.
    """
    spark = df.sparkSession
    release(spark, after=5.0)
    path = path or f"{_folder(spark)}/0"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
