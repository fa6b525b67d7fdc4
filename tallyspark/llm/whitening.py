"""Operator 13: embedding whitening by the exact characteristic polynomial of the scatter.

Entries become integers x = floor(scale * c). Tasks add up exact sums of x and of the products of two
dimensions, from which the integer scatter A = n * sum(x x') - S S' follows; the covariance (divisor n)
is A / n^2 and does not depend on a shift of x. The characteristic polynomial of A is found modulo primes below
2^31, each by reduction to Hessenberg form in a task of its own share, and put together by Chinese
remaindering; its coefficients are exact. All its roots are real, so the number of roots above t is the number of
sign changes of the polynomial shifted by t (Descartes' rule is exact then). That isolates the largest roots, and
exact signs narrow each down to ``ROOT_BITS`` bits. Components come from the null space of A - root: inverse iteration
in fixed-point arithmetic of ``FIXED_BITS`` bits, so they are right to double precision.

What reaches the driver is bounded by the dimension d: d^2 sums and d coefficients per prime, never rows.

Rows whose vector is null or empty, or holds null, non-finite or huge entries (2^31 and more), are dropped, and so are
those whose dimension is not the most frequent one (ties: the larger). Repeated rows count as often as they occur and are
returned as often. Ties of eigenvalues: an orthonormal basis of their space, the same one for all rows. A component without
variance cannot be whitened and has no row, so a table whose vectors are all alike, or an empty one, gives none. The key may be null;
other columns do not matter.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import fresh

ROOT_BITS = 128  # of the largest root
FIXED_BITS = 320
HUGE = float(1 << 31)


# -- exact sums ----------------------------------------------------------------------------------------------------

def _integers(column, d: int, scale: int) -> np.ndarray:
    """floor(scale * entry) of a list column, as whole doubles."""
    return np.floor(np.asarray(column.flatten(), np.float64).reshape(-1, d) * scale)


def _products(y: np.ndarray) -> np.ndarray:
    """y'y in whole numbers: by doubles while every sum stays below 2^53, else by Python integers."""
    big = float(np.abs(y).max()) if y.size else 0.0
    if big * big * max(len(y), 1) < 2.0 ** 53:
        return (y.T @ y).astype(np.int64).astype(object)
    whole = y.astype(np.int64).astype(object)
    return whole.T.dot(whole)


def _sums(rows: DataFrame, vector: str, d: int, scale: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sums per dimension, sums of products; exact."""

    def add(batches):
        import pyarrow as pa
        n, s, q = 0, np.zeros(d, object), np.zeros((d, d), object)
        for b in batches:
            y = _integers(b.column(vector), d, scale)
            if len(y):
                n, s, q = n + len(y), s + y.sum(0).astype(np.int64).astype(object), q + _products(y)
        upper = np.triu_indices(d)
        i = np.concatenate([[-1], np.arange(d), upper[0]])
        j = np.concatenate([[-1], np.full(d, -1), upper[1]])
        values = [n, *s.tolist(), *q[upper].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))],
            names=["i", "j", "v"])

    found = (rows.select(vector).mapInArrow(add, "i int, j int, v decimal(38,0)")
             .groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect())
    n, s, q = 0, [0] * d, np.zeros((d, d), object)
    for i, j, v in found:
        if i < 0:
            n = int(v)
        elif j < 0:
            s[i] = int(v)
        else:
            q[i, j] = q[j, i] = int(v)
    return n, s, q


# -- characteristic polynomial -------------------------------------------------------------------------------------

def _is_prime(n: int) -> bool:
    """Miller-Rabin, certain below 3.2e9 with these bases."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_above(bound: int) -> list[int]:
    """Primes below 2^31, from the largest down, whose product exceeds ``bound``."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - a) modulo p, highest power first, through the Hessenberg form. Entries are below p < 2^31."""
    h, d = a.astype(np.int64) % p, len(a)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        i = k + int(below[0])
        if i != k:
            h[[i, k]] = h[[k, i]]
            h[:, [i, k]] = h[:, [k, i]]
        u = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - u[:, None] * h[k][None, :] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * u[None, :] % p).sum(1)) % p
    # minors: poly[k] is that of the leading k x k part
    poly = np.zeros((d + 1, d + 1), np.int64)  # lowest power first
    poly[0, 0] = 1
    for k in range(1, d + 1):
        factors, t = np.empty(k, np.int64), 1
        factors[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            t = t * int(h[i + 1, i]) % p
            factors[i] = t * int(h[i, k - 1]) % p
        poly[k, 1:] = poly[k - 1, :-1]
        poly[k] = (poly[k] - (factors[:, None] * poly[:k] % p).sum(0)) % p
    return poly[d, ::-1]


def _residues(spark, a: np.ndarray, primes: list[int]) -> dict[int, list[int]]:
    """The polynomial modulo every prime, computed in tasks."""
    digits = [[str(v) for v in row] for row in a.tolist()]  # d^2 numbers

    def run(batches):
        import pyarrow as pa
        whole = np.array([[int(v) for v in row] for row in digits], object).reshape(a.shape)
        for b in batches:
            ps = b.column("prime").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ps, pa.int64()), pa.array([polynomial_mod((whole % p).astype(np.int64), p) for p in ps], pa.list_(pa.int64()))],
                names=["prime", "residues"])

    parts = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    frame = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(parts)
    return {p: r for p, r in frame.mapInArrow(run, "prime long, residues array<long>").collect()}


def characteristic_polynomial(spark, a: np.ndarray) -> list[int]:
    """Exact coefficients of det(x I - A), highest power first, of a positive semidefinite integer matrix A.

    The k-th one is (-1)^k times a sum of products of k eigenvalues, at most C(d, k) (trace / d)^k.
    """
    d, trace = len(a), sum(int(a[k, k]) for k in range(len(a)))
    bound = max(math.comb(d, k) * (-(-trace // d) + 1) ** k for k in range(d + 1))
    primes = primes_above(2 * bound)
    residues = _residues(spark, a, primes)
    product = math.prod(primes)
    weights = {p: (product // p) * pow(product // p, -1, p) for p in primes}
    out = []
    for k in range(d + 1):
        c = sum(w * residues[p][k] for p, w in weights.items()) % product
        out.append(c - product if 2 * c > product else c)
    return out


# -- roots ---------------------------------------------------------------------------------------------------------

def _above(q: list[int], t: int) -> int:
    """How many roots of q (all real; highest power first) exceed t: sign changes of q(x + t)."""
    c = list(q)
    for k in range(len(c) - 1, 0, -1):
        acc = c[0]
        for i in range(1, k + 1):
            acc = c[i] = c[i] + t * acc
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(q: list[int], t: int) -> int:
    value = 0
    for c in q:
        value = value * t + c
    return (value > 0) - (value < 0)


def largest_roots(q: list[int], most: int) -> tuple[list[int], int]:
    """The ``most`` largest positive roots, falling, with multiplicity, as whole multiples of 2^-s; and s.

    q has real roots only and none below 0.
    """
    q = list(q)
    while len(q) > 1 and q[-1] == 0:
        q.pop()
    total = len(q) - 1
    if not total:
        return [], 0
    top = -q[1] // q[0] + 1  # the sum of the roots
    s = max(0, ROOT_BITS - top.bit_length())
    q = [c << (s * k) for k, c in enumerate(q)]
    top = (top << s) + 1
    known = {0: total, top: 0}

    def above(t):
        if t not in known:
            known[t] = _above(q, t)
        return known[t]

    out = []
    for k in range(min(most, total)):  # lo < the k-th root <= hi
        lo = max(t for t, c in known.items() if c > k)
        hi = min(t for t, c in known.items() if c <= k)
        while hi - lo > 1 and above(lo) - above(hi) > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if above(mid) > k else (lo, mid)
        if hi - lo > 1:  # a single root: its side is known from the sign
            after = _sign(q, hi) or 1
            if _sign(q, hi):
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    at = _sign(q, mid)
                    if at == 0:
                        lo, hi = mid - 1, mid
                    elif at == after:
                        hi = mid
                    else:
                        lo = mid
        out.append(hi)
    return out, s


# -- null space ----------------------------------------------------------------------------------------------------

def _shrunk(x: np.ndarray) -> np.ndarray:
    """A vector of integers scaled so that its largest entry has FIXED_BITS bits."""
    extra = max(abs(int(v)) for v in x).bit_length() - FIXED_BITS
    return np.array([int(v) >> extra if extra > 0 else int(v) << -extra for v in x], object)


def _without(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """x less its parts along ``others``, which are orthogonal to each other."""
    for o in others:
        dot, norm = int(x.dot(o)), int(o.dot(o))
        x = np.array([int(v) - dot * int(w) // norm for v, w in zip(x, o)], object)
    return x


def null_vectors(a: np.ndarray, roots: list[int], s: int) -> list[np.ndarray]:
    """Unit eigenvectors of A for its roots (multiples of 2^-s, falling), as doubles."""
    d, found, cluster = len(a), [], []
    unit = 1 << FIXED_BITS
    norm = max(sum(int(a[k, k]) for k in range(d)), 1) << s
    for k, z in enumerate(roots):
        if not k or roots[k - 1] - z > max(2, z >> (ROOT_BITS - 16)):
            cluster = []  # vectors of roots that are alike
            m = np.array([[((int(a[i, j]) << s) - (z if i == j else 0)) * unit // norm for j in range(d)] for i in range(d)], object)
            swaps, factors = [], []
            for c in range(d):
                best = c + max(range(d - c), key=lambda r: abs(m[c + r, c]))
                if best != c:
                    m[[c, best]] = m[[best, c]]
                swaps.append(best)
                if m[c, c] == 0:
                    m[c, c] = 1
                f = np.array([int(v) * unit // int(m[c, c]) for v in m[c + 1:, c]], object)
                factors.append(f)
                if len(f):
                    m[c + 1:, c:] -= (f[:, None] * m[c, c:][None, :]) // unit
        x = np.array([unit + unit // 7 * ((i * (2 * len(cluster) + 3) + 1) % 11) for i in range(d)], object)
        if cluster:
            x = _without(x, cluster)
        for _ in range(3):
            x = _shrunk(x)
            for c in range(d):
                if swaps[c] != c:
                    x[[c, swaps[c]]] = x[[swaps[c], c]]
                if len(factors[c]):
                    x[c + 1:] -= factors[c] * x[c] // unit
            for c in range(d - 1, -1, -1):
                x[c] = (int(x[c]) - (int(m[c, c + 1:].dot(x[c + 1:])) // unit if c + 1 < d else 0)) * unit // int(m[c, c])
            x = _without(_shrunk(x), cluster)
        x = _shrunk(x)
        cluster.append(x)
        length = math.isqrt(int(x.dot(x)))
        found.append(np.array([int(v) / length for v in x]))
    return found


# -- the operator --------------------------------------------------------------------------------------------------

def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = 1024) -> DataFrame:
    """One row per vector and component: ``key``, ``component`` (from 1), ``n``, ``deviation`` (decimal), ``whitened``,
    ``explained``, ``identity_error``, ``eigenvalue``."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    v = fresh("vector", [key])
    fine = F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < HUGE)), F.lit(False))
    # the condition also stands in the projection, so that a row that is dropped is never unpacked
    rows = rows.select(key, F.when(fine, F.col(vector).cast("array<double>")).alias(v)).filter(F.col(v).isNotNull())
    schema = (f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double, eigenvalue double")
    sizes = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d = sizes["d"]
    rows = rows.filter(F.size(v) == d)
    n, s, q = _sums(rows, v, d, scale)
    a = n * q - np.outer(np.array(s, object), np.array(s, object))
    trace = sum(int(a[k, k]) for k in range(d))
    roots, bits = largest_roots(characteristic_polynomial(spark, a), components) if trace else ([], 0)
    if not roots:
        return spark.createDataFrame([], schema)
    vectors = np.array(null_vectors(a, roots, bits))
    e = [z / (n * n << bits) for z in roots]
    explained = [z / (trace << bits) for z in roots]
    project = vectors.T / np.sqrt(e)[None, :]

    def deviations(y: np.ndarray) -> np.ndarray:
        """n * x - S, exact: doubles while that is so, else Python integers."""
        if (np.abs(y).max() if y.size else 0.0) * n + max(map(abs, s)) < 2.0 ** 53:
            return y * n - np.array(s, np.float64)
        return y.astype(np.int64).astype(object) * n - np.array(s, object)

    def whitened(dev: np.ndarray) -> np.ndarray:
        return (dev / n).astype(np.float64) @ project

    def moments(batches):
        import pyarrow as pa
        k = len(roots)
        w1, w2 = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = whitened(deviations(_integers(b.column(v), d, scale)))
            w1, w2 = w1 + w.sum(0), w2 + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([[*w1, *w2.ravel()]], pa.list_(pa.float64()))], names=["m"])

    k = len(roots)
    m = rows.select(v).mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("i", "m"))
    m = np.array([r["m"] for r in m.groupBy("i").agg(F.sum("m").alias("m")).orderBy("i").collect()]) / n
    covariance = m[k:].reshape(k, k) - np.outer(m[:k], m[:k])
    error = float(np.abs(covariance - np.eye(k)).max())

    def emit(batches):
        import pyarrow as pa
        for b in batches:
            dev = deviations(_integers(b.column(v), d, scale))
            w, rows_ = whitened(dev), len(dev)
            if dev.dtype != object and (np.abs(dev).max() if rows_ else 0.0) < 2.0 ** 31 / math.sqrt(d):
                whole = dev.astype(np.int64)
                squares = (whole * whole).sum(1).tolist()
            else:
                squares = [sum(int(x) * int(x) for x in r) for r in dev.tolist()]
            at = np.repeat(np.arange(rows_), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), rows_), pa.int32()),
                 pa.array([n] * len(at), pa.int64()), pa.array([Decimal(x) for x in squares], pa.decimal128(38, 0)).take(pa.array(at)),
                 pa.array(w.ravel()), pa.array(explained * rows_), pa.array([error] * len(at)), pa.array(e * rows_)],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"])

    return rows.select(key, v).mapInArrow(emit, schema)
