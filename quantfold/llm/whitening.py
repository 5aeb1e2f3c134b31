"""Embedding whitening from the exact characteristic polynomial.

1. **Integer scatter.** Every entry c becomes ``floor(64 c) + 1000000``. Tasks
   sum x and x x^T exactly: 20-bit limbs of the entries are multiplied as
   doubles that cannot round, and the partial sums travel as integers of
   three 60-bit limbs, added by Spark as decimals. With n rows, sums S and G =
   sum of x x^T, ``M = n G - S S^T`` is n^2 times the covariance, in integers.
2. **Characteristic polynomial** of M modulo many 31-bit primes: each prime is
   a row of a Spark job that reduces M to Hessenberg form and reads the
   polynomial off. M is positive semi-definite, so its coefficients are
   bounded by Maclaurin's inequality; Chinese remaindering over enough primes
   gives them exactly.
3. **Root isolation.** All roots are real, so Descartes' rule is exact: the
   sign variations of the polynomial shifted to t count the roots above t.
   Bisection on integers isolates the largest roots, then the parity of the
   roots above (the sign) halves each interval to ``BITS`` bits.
4. **Components**: inverse iteration on M - root I, whose null space holds them,
   with fixed-point integers of ``BITS + 64`` bits; a root of multiplicity m
   (or m roots that agree in ``BITS`` bits) gives m orthonormal vectors. Each
   root is a row of a Spark job.

What reaches the driver has a size set by the dimension d alone: d (d + 1) / 2
sums, d + 1 residues a prime, ``components`` vectors and products of them.

Edge cases: a row whose vector is null, or holds null, NaN or infinite
entries, is dropped, and so is one whose entries do not fit a long. Where
vectors differ in length, the commonest length counts (ties: the longest) and
the others are dropped. Only components with a positive eigenvalue can be
whitened, so rank-deficient input gives fewer, and identical vectors, one
vector or an empty table give no rows. Repeated rows and rows without vec_id
each count and return. Equal eigenvalues: any orthonormal basis. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Shared

SCALE, OFFSET = 64, 1_000_000
#: Bits of a root behind the leading one of the largest root.
BITS = 160
_LIMB = 20  # bits of an entry's limbs
_CHUNK = 4096  # rows of one exact product: 2^12 products below 2^40
_WORD = 60  # bits of a sum's limbs
_PART = "i int, j int, h0 long, h1 long, h2 long"


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): integer vectors of the rows that take part, all of one length."""
    e = F.col("embedding").cast("array<double>")
    fits = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 56)))
    x = F.transform(e, lambda v: F.floor(v * SCALE) + F.lit(OFFSET))
    clean = embeddings.filter(F.col("embedding").isNotNull()).filter(fits).select("vec_id", x.alias("x"))
    lengths = clean.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return clean.filter(F.size("x") == (lengths["d"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """``x`` as signed doubles l0 + l1 2^20 + ..., each below 2^20 in size."""
    out = []
    while True:
        if not len(out) and np.abs(x).max(initial=0) < 1 << _LIMB or len(out) == 3:
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << _LIMB) - 1)).astype(np.float64))
        x = x >> _LIMB
        if not x.any():
            return out


def exact_products(x: np.ndarray) -> np.ndarray:
    """x^T x as Python integers, without rounding or overflow."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for lo in range(0, len(x), _CHUNK):
        limbs = _limbs(x[lo:lo + _CHUNK])
        for p, a in enumerate(limbs):
            for q, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (_LIMB * (p + q))
    return total


def _words(value: int) -> tuple[int, int, int]:
    low = (1 << _WORD) - 1
    return value & low, (value >> _WORD) & low, value >> (2 * _WORD)


def scatter(x: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, S, M): rows, sums and the integer scatter ``n G - S S^T``."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, None, None
        for batch in batches:
            rows = _matrix(batch.column(0))
            if rows.size:
                ones = np.concatenate([rows, np.ones((len(rows), 1), np.int64)], 1)
                products = exact_products(ones)
                g = products if g is None else g + products
        if g is None:
            return
        i, j = np.triu_indices(len(g))
        words = [_words(int(g[a, b])) for a, b in zip(i, j)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array([w[k] for w in words], pa.int64()) for k in range(3)]],
            names=["i", "j", "h0", "h1", "h2"])

    summed = x.select("x").mapInArrow(partial, _PART).groupBy("i", "j").agg(
        *[F.sum(F.col(h).cast("decimal(38,0)")).alias(h) for h in ("h0", "h1", "h2")]).collect()  # (d + 1)(d + 2) / 2 rows
    if not summed:
        return 0, np.zeros(0, object), np.zeros((0, 0), object)
    d = max(r["j"] for r in summed)
    g = np.zeros((d + 1, d + 1), object)
    for r in summed:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = int(r["h0"]) + (int(r["h1"]) << _WORD) + (int(r["h2"]) << (2 * _WORD))
    n, s = int(g[d, d]), g[:d, d].copy()
    return n, s, n * g[:d, :d] - np.outer(s, s)


def primes_below(limit: int, product: int) -> list[int]:
    """The largest primes below ``limit`` whose product exceeds ``product``."""
    root = int(limit ** 0.5) + 1
    sieve = np.ones(root + 1, bool)
    sieve[:2] = False
    for k in range(2, int(root ** 0.5) + 1):
        if sieve[k]:
            sieve[k * k::k] = False
    small = np.flatnonzero(sieve)
    out, reached, p = [], 1, limit - 1
    while reached <= product:
        if (p % small[small * small <= p]).all():
            out.append(p)
            reached *= p
        p -= 1
    return out


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first) of det(t I - m) modulo the prime p < 2^31, by Hessenberg reduction."""
    h = (m % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        below = 1
        factors = np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):  # h[i, k-1] times the subdiagonal between row i and k - 1
            factors[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        polys[k] = (polys[k] - (factors[:, None] * polys[:k] % p).sum(0)) % p
    return polys[d]


def polynomial(spark, m: np.ndarray) -> list[int]:
    """Exact characteristic polynomial of the integer scatter (constant first), a prime a row."""
    d, trace = len(m), int(np.trace(m))
    bound, choose = 1, 1
    for k in range(1, d + 1):
        choose = choose * (d - k + 1) // k
        bound = max(bound, choose * (trace // d + 1) ** k)
    primes = primes_below(1 << 31, bound)
    sent = Shared(spark, m)

    def residues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"p": batch["p"], "c": [polynomial_mod(sent.value, int(p)) for p in batch["p"]]})

    rows = (spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64), "p")
            .mapInPandas(residues, "p long, c array<long>").collect())
    out, modulus = [0] * (d + 1), 1
    for r in sorted(rows, key=lambda r: r["p"]):
        p = r["p"]
        inverse = pow(modulus, -1, p)
        for k, residue in enumerate(r["c"]):
            value = residue if (d - k) % 2 == 0 else -residue  # all values are then positive
            out[k] += modulus * ((value - out[k]) * inverse % p)
        modulus *= p
    return [c if (d - k) % 2 == 0 else -c for k, c in enumerate(out)]


def roots_above(poly: list[int], t: int) -> int:
    """How many roots (all real) exceed t: sign variations of the coefficients shifted to t."""
    shifted = poly[:]
    for k in range(len(poly) - 1):
        for i in range(len(poly) - 2, k - 1, -1):
            shifted[i] += t * shifted[i + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(poly: list[int], t: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * t + c
    return out


def largest_roots(poly: list[int], most: int) -> tuple[list[tuple[int, int]], int]:
    """([(r, multiplicity)], s) of the largest positive roots r / 2^s, largest first, about ``most`` of them."""
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]
    rank = len(poly) - 1
    if rank == 0:
        return [], 0
    top = -poly[-2]  # the sum of the roots
    s = max(0, BITS - top.bit_length())
    fine = [c << (s * (rank - k)) for k, c in enumerate(poly)]
    out = []
    # (low, high, roots above high, roots inside, on the fine grid); the largest interval is looked at first
    todo = [(0, top, 0, rank, False)]
    while todo and sum(k for _, k in out) < most:
        low, high, above, inside, fine_now = todo.pop()
        if inside == 1 and not fine_now:
            low, high, fine_now = low << s, high << s, True
        if inside == 1:
            while high - low > 1:
                middle = (low + high) // 2
                value = _value(fine, middle)
                if value == 0:
                    high = middle
                    break
                # the sign says whether an odd number of roots exceeds the middle
                if (value < 0) == ((above + 1) % 2 == 1):
                    low = middle
                else:
                    high = middle
            out.append((high, 1))
        elif high - low > 1:
            middle = (low + high) // 2
            higher = roots_above(fine if fine_now else poly, middle)
            if above + inside > higher:
                todo.append((low, middle, higher, above + inside - higher, fine_now))
            if higher > above:
                todo.append((middle, high, above, higher - above, fine_now))
        elif not fine_now and s:
            todo.append((low << s, high << s, above, inside, True))
        else:
            out.append((high, inside))  # equal in every bit
    return out, s


def null_space(m: np.ndarray, root: int, s: int, size: int) -> np.ndarray:
    """``size`` orthonormal vectors (rows) of the null space of m - root / 2^s by inverse iteration."""
    d = len(m)
    a = m * (1 << s)
    a[np.arange(d), np.arange(d)] -= root
    bits = BITS + 64
    shift = bits - max(1, max(abs(int(v)).bit_length() for v in (m * (1 << s)).ravel()))
    a = a << shift if shift >= 0 else a >> -shift
    order = np.arange(d)
    for k in range(d):  # LU with row pivots, in fixed point
        pivot = k + int(np.argmax(np.abs(a[k:, k])))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[[k, pivot]] = order[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1  # singular to the last bit
        if k + 1 < d:
            factor = (a[k + 1:, k] << bits) // a[k, k]
            a[k + 1:, k + 1:] -= (factor[:, None] * a[k, k + 1:]) >> bits
            a[k + 1:, k] = factor

    def normal(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            most = max(abs(int(v)).bit_length() for v in z)
            z = z << (bits - most) if bits >= most else z >> (most - bits)
            for o in others:
                z = z - ((int((z * o).sum()) >> bits) * o >> bits)
        from math import isqrt
        length = isqrt(int((z * z).sum())) or 1
        return (z << bits) // length

    start = np.random.default_rng(12)
    out: list[np.ndarray] = []
    for _ in range(size):
        z = start.integers(-(1 << 30), 1 << 30, d).astype(object)
        for _ in range(3):
            z = normal(z, out)[order]
            for k in range(1, d):
                z[k] -= int((a[k, :k] * z[:k]).sum()) >> bits
            for k in range(d - 1, -1, -1):
                z[k] = ((int(z[k]) << bits) - int((a[k, k + 1:] * z[k + 1:]).sum())) // a[k, k]
        out.append(normal(z, out))
    vectors = np.array([[float(int(v) >> (bits - 100)) * 2.0 ** -100 for v in z] for z in out])
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def fit(x: DataFrame, components: int = 32) -> dict:
    """n, sums, eigenvalues of the covariance, explained shares and component vectors of (vec_id, x)."""
    spark = x.sparkSession
    n, sums, m = scatter(x)
    empty = {"n": n, "sums": sums, "values": np.zeros(0), "explained": np.zeros(0), "vectors": np.zeros((0, len(sums)))}
    if n == 0 or not m.any():
        return empty
    roots, s = largest_roots(polynomial(spark, m), components)
    sent = Shared(spark, m)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                found = null_space(sent.value, int(r.root), s, int(r.size))
                yield pd.DataFrame({"first": [r.first] * len(found), "k": range(len(found)), "v": list(found)})

    firsts = np.cumsum([0, *[k for _, k in roots]])[:-1].tolist()
    rows = [(f, str(r), k) for f, (r, k) in zip(firsts, roots)]
    found = (spark.createDataFrame(rows, "first int, root string, size int").repartition(min(len(rows), 64), "first")
             .mapInPandas(solve, "first int, k int, v array<double>").collect())  # one row a component
    ordered = sorted(found, key=lambda r: (r["first"], r["k"]))[:components]
    values = [r for r, k in roots for _ in range(k)][:components]
    trace = int(np.trace(m)) << s
    return empty | {"values": np.array([v / ((n * n) << s) for v in values]), "explained": np.array([v / trace for v in values]),
                    "vectors": np.array([r["v"] for r in ordered])}


def _projector(model: dict):
    """Function from integer rows to (deviations as Python integers, whitened rows)."""
    n, sums = model["n"], model["sums"]
    whole = np.array([int(v) // n for v in sums], np.int64)
    rest = np.array([int(v) % n for v in sums], object)
    rest_square = int((rest * rest).sum())
    weights = (model["vectors"] / np.sqrt(model["values"])[:, None]).T
    fraction = np.array([int(v) / n for v in rest])

    def run(x: np.ndarray) -> tuple[list[int], np.ndarray]:
        t = x - whole
        if len(t) and float(np.abs(t).max()) ** 2 * t.shape[1] < 2.0 ** 62:
            squares = (t * t).sum(1).tolist()
        else:
            squares = (t.astype(object) ** 2).sum(1).tolist()
        crossed = (t.astype(object) @ rest).tolist()
        return ([n * n * q - 2 * n * c + rest_square for q, c in zip(squares, crossed)], (t - fraction) @ weights)

    return run


def identity_error(x: DataFrame, model: dict) -> float:
    """Largest absolute entry of (covariance of the whitened rows - identity)."""
    sent = Shared(x.sparkSession, model)
    k = len(model["values"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, total = _projector(sent.value), np.zeros((k + 1, k + 1))
        for batch in batches:
            if batch.num_rows:
                _, w = run(_matrix(batch.column(0)))
                w = np.concatenate([w, np.ones((len(w), 1))], 1)
                total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                          pa.array(total.ravel())], names=["i", "j", "v"])

    total = np.zeros((k + 1, k + 1))
    for r in x.select("x").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    mean = total[:k, k] / model["n"]
    return float(np.abs(total[:k, :k] / model["n"] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row a vector and component."""
    schema = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    x = vectors(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    model = fit(x, components)
    k = len(model["values"])
    if k == 0:
        return embeddings.sparkSession.createDataFrame([], schema)
    model["identity_error"] = identity_error(x, model)
    sent = Shared(embeddings.sparkSession, model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal
        fitted = sent.value
        run = _projector(fitted)
        for batch in batches:
            for lo in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(lo, _CHUNK)
                deviations, w = run(_matrix(part.column(1)))
                each = pa.array(np.repeat(np.arange(part.num_rows), k))
                # a deviation over 38 digits has no decimal: null
                exact = pa.array([Decimal(v) if v < 10 ** 38 else None for v in deviations], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), part.num_rows), pa.int32()),
                     pa.array(np.full(len(each), fitted["n"])), exact.take(each), pa.array(w.ravel()),
                     pa.array(np.tile(fitted["explained"], part.num_rows)),
                     pa.array(np.full(len(each), fitted["identity_error"]))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(rows, schema)
