"""Whitening against numpy's eigenvectors, exact deviations, clusters of eigenvalues and odd rows."""

import math

import numpy as np
import pytest

from seasoncast.llm.embedding_whitening import WhitenRules, leading_components, leading_values, sturm_counts, tridiagonal, whiten

SCHEMA = "vec_id long, embedding array<double>, n string, x int"


def rows_of(spark, rows, rules=WhitenRules()):
    df = spark.createDataFrame([(i, v, "extra", 1) for i, v in rows], SCHEMA).repartition(3)
    return whiten(df, rules).collect()


def lattice(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def held_to_plain(spark, rows, k=16):
    clean = [(i, lattice(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in clean}), dtype=np.int64)
    n, sums, d = len(fit), fit.sum(0), fit.shape[1]
    y = (fit * n - sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    got = rows_of(spark, rows, WhitenRules(components=k))
    k = min(k, d)
    assert len(got) == len(clean) * k and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    by = {}
    for i, x in clean:
        z = (np.array(x) - sums / n) @ vectors / np.sqrt(values)
        by.setdefault(i, []).append((sum((n * a - int(s)) ** 2 for a, s in zip(x, sums)), np.round(np.abs(z), 6).tolist()))
    mine, sign = {}, {}
    for r in got:
        mine.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(y.T @ y / n)) < 1e-9
    for i, wanted in by.items():
        for deviation, z in wanted:
            for c in range(k):
                assert any(abs(abs(r["whitened"]) - z[c]) < 1e-5 for r in mine[i, deviation][c + 1])
    # one sign for a whole component
    for i, x in clean:
        dev = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        z = (np.array(x) - sums / n) @ vectors / np.sqrt(values)
        for c in range(k):
            r = mine[i, dev][c + 1][0]
            if abs(z[c]) > 1e-3 and len({tuple(x2) for j, x2 in clean if j == i}) == 1:
                assert sign.setdefault(c, np.sign(r["whitened"] * z[c])) == np.sign(r["whitened"] * z[c])


def test_equals_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 20)) * np.linspace(3, 0.2, 20)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(400 + i, base[5].tolist()) for i in range(200)] + [(7, base[7].tolist()), (None, base[8].tolist())]
    rows += [(700, None), (701, base[1].tolist()[:-1] + [None]), (702, [float("nan")] * 20), (703, [float("inf")] + [0.0] * 19)]
    held_to_plain(spark, rows)


def test_fewer_entries_than_components(spark):
    rng = np.random.default_rng(5)
    held_to_plain(spark, [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 3)) * [4, 2, 1])])


def test_no_directions_and_empty(spark):
    assert rows_of(spark, []) == []
    assert rows_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert rows_of(spark, [(1, []), (2, None)]) == []
    flat = rows_of(spark, [(i, [float(i), 1.0, 2.0]) for i in range(9)])
    assert len(flat) == 9 and {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12


def test_other_widths_left_out_and_long_entries(spark):
    got = rows_of(spark, [(i, [float(i), float(-i * i)]) for i in range(9)] + [(20, [1.0]), (21, [1.0, 2.0, 3.0])])
    assert {r["vec_id"] for r in got} == set(range(9))
    large = rows_of(spark, [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 3.0])])
    assert {r["vec_id"] for r in large} == {1, 2, 3} and all(r["deviation"] is None for r in large)
    with pytest.raises(ValueError):
        rows_of(spark, [(i, [float(i)] * 5) for i in range(3)], WhitenRules(max_width=4))


@pytest.mark.parametrize("kind", ["random", "repeated", "close", "diagonal", "one", "two"])
def test_eigenpairs(kind):
    rng = np.random.default_rng(1)
    d = {"one": 1, "two": 2}.get(kind, 40)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = np.sort(rng.random(d))[::-1] + 0.1
    if kind == "repeated":
        values[:5] = 2.0
    if kind == "close":
        values[:6] = 2 + 1e-13 * np.arange(6)[::-1]
    a = np.diag(values) if kind == "diagonal" else (q * values) @ q.T
    a = (a + a.T) / 2
    k = min(16, d)
    got, vectors = leading_components(a, k)
    assert np.abs(got - values[:k]).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_sturm_counts():
    a = np.random.default_rng(2).standard_normal((12, 12))
    diagonal, off, _ = tridiagonal(a + a.T)
    true = np.linalg.eigvalsh(a + a.T)
    at = np.linspace(true[0] - 1, true[-1] + 1, 50)
    assert sturm_counts(diagonal, off, at).tolist() == [(true < x).sum() for x in at]
    assert np.abs(leading_values(diagonal, off, 5) - true[::-1][:5]).max() < 1e-12
