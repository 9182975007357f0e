"""Whitening of embeddings: distributed centred covariance, leading eigenvectors, broadcast projection.

Tasks sum what a batch of vectors adds to counts, sums and the centred
covariance; a task emits its sums once, whatever its rows.  The covariance (d x d)
comes to the driver, where d is bounded by ``max_width``: Householder
reflections make it tridiagonal, bisection on Sturm counts finds the leading
eigenvalues, inverse iteration their vectors, made orthogonal again inside
clusters of close eigenvalues.  The components (d x k) are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.session import materialise

SCALE, SHIFT = 64, 1_000_000
_LARGEST = 1 << 52
_EPS = np.finfo(np.float64).eps


@dataclass(frozen=True)
class WhitenRules:
    components: int = 16
    max_width: int = 4096  # largest d whose covariance the driver takes


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` distinct vectors, their exact sums, and the components."""

    n: int
    sums: np.ndarray          # S, exact
    components: np.ndarray    # d x k, unit columns
    values: np.ndarray        # k eigenvalues, falling
    trace: float
    identity_error: float


def lattice(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of the vectors without null or non-finite entries; ``x = floor(64 c) + 1000000`` as longs.

    64 c is held within 2**52 either way, so that every x is exact.
    """
    c = lambda v: v.cast("double")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(c(v)) & (F.abs(c(v)) < float("inf")))
    held = lambda v: F.greatest(F.least(c(v) * SCALE, F.lit(float(_LARGEST))), F.lit(-float(_LARGEST)))
    x = F.transform("embedding", lambda v: F.floor(held(v)).cast("long") + F.lit(SHIFT))
    return vectors.select("vec_id", "embedding").where(finite).select("vec_id", x.alias("x"))


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - S`` exactly: in 64-bit integers where they hold it, else in Python's."""
    if x.size == 0 or n * int(np.abs(x).max()) < 1 << 61 and int(np.abs(sums).max()) < 1 << 61:
        return x * n - sums
    return x.astype(object) * n - sums.astype(object)


def _squares(y: np.ndarray) -> list:
    """Exact sums of squares by row; None where a long can't hold one."""
    if y.dtype != object and (y.size == 0 or int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 63):
        return (y * y).sum(1).tolist()
    totals = (int(s) for s in (y.astype(object) ** 2).sum(1))
    return [s if s < 1 << 63 else None for s in totals]


def _sums(d: int):
    def run(batches):
        n, sums = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, x.astype(object).sum(0) if x.size and np.abs(x).max() > 1 << 32 else x.sum(0))]
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [[str(s) for s in sums]]}, pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string()))]))
    return run


def _products(fit, d: int, project):
    """Sums of ``y y'`` of the centred rows (projected if ``project``), one row of the matrix at a time."""
    def run(batches):
        n, sums = fit.value[:2]
        total = None
        for batch in batches:
            y = _deviations(_matrix(batch.column(0), d), n, sums).astype(np.float64) / n
            y = project(y, fit.value) if project else y
            total = y.T @ y + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])
    return run


def _whitened(y: np.ndarray, fit) -> np.ndarray:
    return (y @ fit[2]) / np.sqrt(fit[3])


def _add_up(rows: DataFrame, n: int) -> np.ndarray:
    """The matrix whose rows the tasks sent, summed by row."""
    summed = rows.groupBy("i").applyInPandas(lambda p: p.iloc[:1].assign(v=[np.sum(np.stack(p["v"].to_numpy()), axis=0)]), rows.schema)
    held = {r["i"]: r["v"] for r in summed.collect()}
    return np.array([held[i] for i in range(len(held))]) / n


def tridiagonal(a: np.ndarray):
    """Householder: diagonal, off-diagonal and reflectors of ``H a H`` for a symmetric ``a``."""
    a, reflectors = a.astype(np.float64).copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        if length == 0 or np.linalg.norm(v[1:]) == 0:
            reflectors.append(None)
            continue
        alpha = -np.copysign(length, v[0])
        v[0] -= alpha
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - (p @ v) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = alpha
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each value of ``at``."""
    least = np.finfo(np.float64).tiny * max(1.0, float((off ** 2).max(initial=0)))
    q = diagonal[0] - at
    below = (q < 0).astype(np.int64)
    for a, b in zip(diagonal[1:], off ** 2):
        q = a - at - b / np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection to the last bits."""
    d = len(diagonal)
    reach = np.concatenate([np.abs(off), [0]]) + np.concatenate([[0], np.abs(off)])
    lo, hi = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    wide = _EPS * max(np.abs(lo).max(), np.abs(hi).max()) + np.finfo(np.float64).tiny
    lo, hi = lo - wide * d, hi + wide * d
    rank = d - 1 - np.arange(k)  # eigenvalues below the j-th largest
    for _ in range(200):
        mid = lo + (hi - lo) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            break
        low = sturm_counts(diagonal, off, mid) <= rank
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return lo + (hi - lo) / 2


def _solver(diagonal, off, shift: float, norm: float):
    """Solve ``(T - shift) x = b`` again and again: elimination with partial pivoting, pivots kept off zero."""
    d = len(diagonal)
    a, up, up2 = (diagonal - shift).tolist(), off.tolist() + [0.0], [0.0] * d
    steps = []
    for i in range(d - 1):
        below, least = float(off[i]), _EPS * norm
        if abs(a[i]) >= abs(below):
            a[i] = a[i] if abs(a[i]) > least else least
            m = below / a[i]
            steps.append((False, m))
            a[i + 1] -= m * up[i]
        else:
            m = a[i] / below
            steps.append((True, m))
            a[i], a[i + 1], next_up = below, up[i] - m * a[i + 1], up[i + 1]
            up[i], up2[i], up[i + 1] = diagonal[i + 1] - shift, next_up, -m * next_up
    a[-1] = a[-1] if abs(a[-1]) > _EPS * norm else _EPS * norm

    def solve(b):
        x = b.tolist()
        for i, (swap, m) in enumerate(steps):
            if swap:
                x[i], x[i + 1] = x[i + 1], x[i] - m * x[i + 1]
            else:
                x[i + 1] -= m * x[i]
        for i in range(d - 1, -1, -1):
            s = x[i]
            if i + 1 < d:
                s -= up[i] * x[i + 1]
            if i + 2 < d:
                s -= up2[i] * x[i + 2]
            x[i] = s / a[i]
        return np.array(x)
    return solve


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors of the given eigenvalues (falling), as columns, by inverse iteration.

    Eigenvalues within 1e-3 of the norm of the one before form a cluster; its
    vectors are made orthogonal to each other in every round, twice.
    """
    d = len(diagonal)
    norm = max(float((np.abs(diagonal) + np.concatenate([np.abs(off), [0]]) + np.concatenate([[0], np.abs(off)])).max()), np.finfo(np.float64).tiny)
    rng, out, first, last = np.random.default_rng(0), np.zeros((d, len(values))), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        last = min(value, last - 10 * _EPS * norm) if j > first else value  # equal values get pivots of their own
        solve, x = _solver(diagonal, off, last, norm), rng.standard_normal(d)
        for _ in range(rounds):
            x /= np.abs(x).max()
            x = solve(x)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading_components(a: np.ndarray, k: int):
    """``(values, vectors)`` of the ``k`` largest eigenvalues of a symmetric matrix, signs by the largest entry."""
    diagonal, off, reflectors = tridiagonal(a)
    values = leading_values(diagonal, off, k)
    vectors = leading_vectors(diagonal, off, values)
    for i in range(len(reflectors) - 1, -1, -1):
        if reflectors[i] is not None:
            v = reflectors[i]
            vectors[i + 1:] -= 2 * np.outer(v, v @ vectors[i + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])


def fit_whitening(rows: DataFrame, rules: WhitenRules = WhitenRules()) -> Whitening | None:
    """Fit on the distinct vectors of ``rows`` (``x``), those of the width that most rows have (the lesser of equals).

    None if there are none.  Components whose eigenvalue is rounding error of the largest are left out.
    """
    spark = rows.sparkSession
    distinct = materialise(rows.groupBy("x").agg(F.count("*").alias("rows")), "vectors")
    width = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), "d").first()
    if width is None or width["d"] == 0:
        return None
    d = width["d"]
    if d > rules.max_width:
        raise ValueError(f"vectors of {d} entries; max_width is {rules.max_width}")
    fit_list = distinct.where(F.size("x") == d).select("x").coalesce(4 * spark.sparkContext.defaultParallelism)
    part = fit_list.mapInArrow(_sums(d), "n long, sums array<string>").select("n", F.posexplode("sums").alias("i", "s"))
    total = {r["i"]: r for r in part.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n, exact = total[0]["n"], [int(total[i]["s"]) for i in range(d)]
    sums = np.array(exact, np.int64 if max(map(abs, exact)) < 1 << 62 else object)
    schema = "i long, v array<double>"
    cov = _add_up(fit_list.mapInArrow(_products(spark.sparkContext.broadcast((n, sums)), d, None), schema), n)
    cov, trace = (cov + cov.T) / 2, float(np.trace(cov))
    if not trace > 0:  # all vectors equal
        return None
    values, vectors = leading_components(cov, min(rules.components, d))
    real = values > d * _EPS * max(float(values[0]), 0.0)
    values, vectors = values[real], vectors[:, real]
    shipped = spark.sparkContext.broadcast((n, sums, vectors, values))
    seen = _add_up(fit_list.mapInArrow(_products(shipped, d, _whitened), schema), n)
    return Whitening(n, sums, vectors, values, trace, float(np.abs(seen - np.eye(len(values))).max()))


def _project(fit, trace: float, error: float):
    def run(batches):
        n, sums, vectors, values = fit.value
        d, k = vectors.shape
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                y = _deviations(_matrix(part.column(1), d), n, sums)
                white = _whitened(y.astype(np.float64) / n, fit.value)
                row = np.repeat(np.arange(part.num_rows), k)
                column = np.tile(np.arange(k), part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array((column + 1).astype(np.int32)), pa.array(np.full(len(row), n)),
                     pa.array(_squares(y), pa.int64()).take(pa.array(row)), pa.array(white.ravel()), pa.array((values / trace)[column]),
                     pa.array(np.full(len(row), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, rules: WhitenRules = WhitenRules()) -> DataFrame:
    """A row for each vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``vectors`` has ``vec_id`` (any type) and ``embedding`` (array of numbers);
    more columns are ignored.  Vectors that are null or hold a null or
    non-finite entry are left out, and those of another width than most.  The
    fit takes each distinct vector once, so copies weigh nothing; every row,
    copy or not, null id or not, is projected.  ``deviation`` is exact (null if
    beyond a long).  There are as many components as the vectors have directions,
    at most ``components``: none for an empty table or equal vectors, which give no rows.
    """
    rows = lattice(vectors)
    fit = fit_whitening(rows, rules)
    spark = vectors.sparkSession
    schema = (f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, "
              "whitened double, explained double, identity_error double")
    if fit is None:
        return spark.createDataFrame([], schema)
    shipped = spark.sparkContext.broadcast((fit.n, fit.sums, fit.components, fit.values))
    return (rows.where(F.size("x") == len(fit.sums))
            .mapInArrow(_project(shipped, fit.trace, fit.identity_error), schema))
