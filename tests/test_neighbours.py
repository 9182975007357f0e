"""The kNN kernel on ties, nulls and equal vectors; the cell index on clusters, uneven cells and odd tables."""

import math
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seasoncast.operators import ann, similarity

VECTORS = "id long, vec array<double>"


def plain(queries, corpus, k, exclude_self=True):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    out = set()
    for qid, q in queries:
        scored = sorted((-round(float(unit(q) @ unit(c)), 9), cid) for cid, c in corpus if not (exclude_self and cid == qid))
        out |= {(qid, cid, r, -s + 0.0) for r, (s, cid) in enumerate(scored[:k], 1)}
    return out


def rows_of(df):
    return {(r.query_id, r.neighbor_id, r["rank"], r.similarity + 0.0) for r in df.collect()}


def corpus(n=120, seed=1):
    rng = np.random.default_rng(seed)
    base = [rng.integers(-2, 3, 6).astype(float).tolist() for _ in range(n // 3)]  # many ties
    return [(i, base[int(rng.integers(len(base)))]) for i in range(n)] + [(n, [0.0] * 6), (n + 1, [0.0] * 6)]


@pytest.mark.parametrize("block_rows", [None, 7])
def test_ties_and_zero_vectors(spark, block_rows):
    rows = corpus()
    df = spark.createDataFrame(rows, VECTORS)
    assert rows_of(similarity.knn_join(df, df, k=5, block_rows=block_rows)) == plain(rows, rows, 5)
    assert rows_of(similarity.knn_join(df, df.limit(3), k=5, exclude_self=False)) == plain(rows, rows[:3], 5, False)


def test_null_vectors_and_empty_sides(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 1.0]), (4, None)], VECTORS)
    assert {(r.query_id, r.neighbor_id) for r in similarity.knn_join(df, df, k=3).collect()} == {(1, 3), (3, 1)}
    assert similarity.knn_join(df, df.where("id > 9"), k=3).count() == 0
    assert similarity.knn_join(df.where("vec is null"), df, k=3).count() == 0


def test_equal_vectors_stay_small():
    n = 8192
    side = pd.DataFrame({"id": np.arange(n)[::-1], "vec": [np.ones(8)] * n})
    tracemalloc.start()
    out = similarity.block_topk(10, True, 9)(None, side, side)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    assert len(out) == 10 * n
    first = out[out["query_id"] == 3]
    assert sorted(first["neighbor_id"]) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]


def clusters(n, seed=2, width=16, groups=40):
    """Points around centres of very uneven size: the first group holds a third of them."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, width))
    group = np.where(rng.random(n) < 0.33, 0, rng.integers(0, groups, n))
    return [(int(i), (centres[g] + 0.25 * rng.standard_normal(width)).tolist()) for i, g in enumerate(group)]


def test_index_finds_the_neighbours_with_few_probes(spark):
    rows = clusters(4000)
    df = spark.createDataFrame(rows, VECTORS).repartition(4).cache()
    index = ann.CellIndex.fit(df, part_rows=100)
    probes = index.calibrate(10, recall=0.97, queries=400)
    assert probes <= len(index.centres) // 3
    loaded = ann.CellIndex.load(spark, index.path)
    assert loaded.probes == probes and np.array_equal(loaded.centres, index.centres)
    asked = df.where("id % 10 = 3")
    got = ann.recall(loaded.search(asked, 10, exclude_self=True), similarity.knn_join(asked, df, k=10)).first()
    assert got["n_queries"] == 400 and got["n_found"] >= 0.95 * got["n_neighbors"] == 3800
    assert max(r["n"] for r in loaded.cells.groupBy("cell", "part").count().withColumnRenamed("count", "n").collect()) < 160
    assert loaded.cells.count() == 4000
    assert rows_of(loaded.search(asked, 10, probes=10 ** 6, exclude_self=True)) == rows_of(similarity.knn_join(asked, df, k=10))


def test_index_on_odd_tables(spark):
    ties = spark.createDataFrame([*corpus(60), (500, None)], VECTORS)
    index = ann.CellIndex.fit(ties, n_cells=9, part_rows=5)
    assert index.cells.count() == 62
    assert rows_of(index.search(ties, 4, probes=99)) == rows_of(similarity.knn_join(ties, ties, 4, exclude_self=False))
    one = ann.CellIndex.fit(ties.where("id = 3"))
    assert len(one.centres) == 1 and one.search(ties.where("id < 5"), 2).count() == 5
    none = ann.CellIndex.fit(ties.where("id < 0"))
    assert none.search(ties, 2).count() == 0 and none.calibrate() == 1
    with pytest.raises(ValueError):
        ann.CellIndex.fit(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], VECTORS))
    # the start is drawn from a bounded share; every row is indexed
    share = ann.CellIndex.fit(spark.createDataFrame(clusters(600), VECTORS), train_rows=50, centre_bytes=8 * 16 * 12)
    assert len(share.centres) == 12 and share.cells.count() == 600


def test_rows_with_one_vector_are_compared_once(spark, monkeypatch):
    """A pair of vectors is scored once, whatever the number of their rows; every row gets its own neighbours."""
    rng = np.random.default_rng(4)
    base = [rng.integers(-2, 3, 5).astype(float).tolist() for _ in range(12)]
    rows = [(i, base[int(rng.integers(12))]) for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS)
    seen, plain_pairs = [], similarity._block_pairs

    def counted(q, c, *more):
        seen.append((q.count(), c.count()))
        return plain_pairs(q, c, *more)

    monkeypatch.setattr(similarity, "_block_pairs", counted)
    assert rows_of(similarity.knn_join(df, df.where("id % 3 > 0"), k=6)) == plain(rows, [r for r in rows if r[0] % 3], 6)
    assert rows_of(similarity.knn_join(df, df, k=6, exclude_self=False)) == plain(rows, rows, 6, False)
    distinct = len({tuple(v) for _, v in rows})
    assert max(max(n) for n in seen) == distinct
    index = ann.CellIndex.fit(df, n_cells=4, part_rows=20)
    assert rows_of(index.search(df, 6, probes=99, exclude_self=True)) == plain(rows, rows, 6)


def test_repeated_ids_are_compared_row_by_row(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted((r.query_id, r.neighbor_id, r["rank"]) for r in similarity.knn_join(df, df, k=2).collect())
    assert got == [(1, 3, 1), (1, 3, 2), (2, 1, 1), (2, 1, 2), (3, 1, 1), (3, 1, 2)]


@pytest.mark.parametrize("digits", [9, 1, None])
def test_narrowed_blocks_keep_the_best(digits):
    """Few candidates of a block are ordered; ties by rounding and rows left out do not change what is found."""
    rng = np.random.default_rng(5)
    side = pd.DataFrame({"id": rng.permutation(3000), "vec": list(rng.standard_normal((3000, 8)))})
    asked = side.iloc[:40]
    got = similarity.block_topk(5, True, digits)(None, asked, side)
    unit = similarity._unit(side["vec"])
    sim = similarity._unit(asked["vec"]) @ unit.T
    sim = sim if digits is None else np.round(sim, digits)
    for n, qid in enumerate(asked["id"]):
        best = sorted((-s, i) for s, i in zip(sim[n], side["id"]) if i != qid)[:5]
        mine = got[got["query_id"] == qid]
        assert sorted(zip(-mine["similarity"], mine["neighbor_id"])) == best


def test_vectors_are_no_sort_or_join_keys(spark):
    """Zeros of both signs and odd numbers are one vector, found by its hash; no plan brings vectors into normal form to sort by them."""
    rows = [(0, [0.0, 1.0]), (1, [-0.0, 1.0]), (2, [math.nan, 1.0]), (3, [math.nan, 1.0]), (4, [1.0, 2.0]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, VECTORS)
    vectors, members = similarity.first_of_equals(df, "test")
    assert sorted(r.id for r in vectors.collect()) == [0, 2, 4]
    assert sorted((r["id"], r["first"]) for r in members.collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 0)]
    assert "normalizenanandzero" not in similarity.knn_join(df, df, k=2)._jdf.queryExecution().executedPlan().toString()


def test_single_precision_only_narrows():
    """Neighbours whose similarities agree in single precision are told apart by nine digits."""
    angle = np.arange(2000) * 2e-4
    side = pd.DataFrame({"id": np.random.default_rng(6).permutation(2000), "vec": list(np.stack([np.cos(angle), np.sin(angle)], axis=1))})
    asked = side.iloc[::50]
    got = similarity.block_topk(4, True, 9)(None, asked, side)
    sim = np.round(similarity._unit(asked["vec"]) @ similarity._unit(side["vec"]).T, 9)
    for n, qid in enumerate(asked["id"]):
        best = sorted((-s, i) for s, i in zip(sim[n], side["id"]) if i != qid)[:4]
        mine = got[got["query_id"] == qid]
        assert sorted(zip(-mine["similarity"], mine["neighbor_id"])) == best


def test_block_pairs_are_not_put_together(spark):
    """Many small block pairs stay apart, so that every core has some."""
    df = spark.createDataFrame(clusters(400), VECTORS)
    sides = [similarity.vectors_of(df, "id", "vec") for _ in range(2)]
    pairs = similarity._block_pairs(*sides, 3, True, 100, 9)
    used = pairs.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= 6 and pairs.count() == 400 * 4 * 3


def test_queries_go_once_to_a_bin_of_cells(spark, monkeypatch):
    """Not a row for each probed cell: with all cells probed nothing is written, with some a row for each bin at most."""
    rows = clusters(3000)
    df = spark.createDataFrame(rows, VECTORS).repartition(4).cache()
    index = ann.CellIndex.fit(df, part_rows=40)
    exact = rows_of(similarity.knn_join(df, df, 5))
    sent, plain_write = [], ann.materialise

    def counted(frame, name="table"):
        out = plain_write(frame, name)
        if name == "ann-probes":
            sent.append(out.count())
        return out

    monkeypatch.setattr(ann, "materialise", counted)
    monkeypatch.setattr(ann, "block_size", lambda *sizes: 700)
    cells = len(index.centres)
    assert rows_of(index.search(df, 5, probes=cells, exclude_self=True)) == exact and not sent
    assert rows_of(index.search(df, 5, probes=cells - 1, exclude_self=True)) == exact and sent == [3000 * 5]
    # a few cells: only what lies in them is found
    probes = 3
    units = lambda f: {r.id: np.array(r.vec) / np.linalg.norm(r.vec) for r in f.collect()}
    vectors, lies = units(df), {r.id: r.cell for r in index.cells.collect()}
    want = set()
    for r in df.where("id % 100 = 7").collect():
        probed = set(np.argsort(-np.round(index.centres @ vectors[r.id], 9), kind="stable")[:probes])
        best = sorted((-round(float(vectors[r.id] @ vectors[i]), 9), i) for i in vectors if i != r.id and lies[i] in probed)[:5]
        want |= {(r.id, i) for _, i in best}
    got = index.search(df.where("id % 100 = 7"), 5, probes=probes, exclude_self=True)
    assert {(r.query_id, r.neighbor_id) for r in got.collect()} == want and sent[-1] <= 30 * probes


def test_vectors_stay_where_they_are_unless_hashes_meet(spark, monkeypatch):
    """Members are joined by hash alone if a hash names one vector; vectors that share a hash are still told apart."""
    rows = [(i, [float(i % 7), 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, VECTORS)
    joins, plain_write = [], similarity.materialise

    def watched(frame, name="table"):
        joins.extend(x for x in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
        return plain_write(frame, name)

    monkeypatch.setattr(similarity, "materialise", watched)
    members = {(r["id"], r["first"]) for r in similarity.first_of_equals(df, "test")[1].collect()}
    assert members == {(i, i % 7) for i in range(50)}
    assert joins and not any("vec" in x for x in joins)
    monkeypatch.setattr(similarity.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    vectors, members = similarity.first_of_equals(df, "test")
    assert vectors.count() == 7 and {(r["id"], r["first"]) for r in members.collect()} == {(i, i % 7) for i in range(50)}


@pytest.mark.parametrize("digits", [9, None])
def test_bins_hold_the_best_not_so_many_of_each_cell(digits):
    """A row that names many cells of a bin keeps its best alone; ties, cells not named and cells that lie elsewhere do not change what is found."""
    rng = np.random.default_rng(8)
    n, cells = 4000, 200
    vectors = rng.integers(-3, 4, (n, 8)).astype(float)
    c = pd.DataFrame({"cell": rng.integers(0, cells, n), "id": rng.permutation(n), "vec": list(vectors)})
    named = [np.sort(rng.choice(cells + 5, 120, replace=False)) for _ in range(n - 3)] + [np.array([7]), np.array([cells + 1]), np.array([3, cells + 4])]
    q = pd.DataFrame({"id": c["id"], "vec": c["vec"], "cells": named})
    tracemalloc.start()
    got = ann._bin_topk(10, True, digits)(None, q, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # ten of each named cell are 115 MB
    unit = similarity._unit(c["vec"])
    for at in [*range(0, n, 400), n - 3, n - 2, n - 1]:
        sim = unit @ unit[at]
        sim = sim if digits is None else np.round(sim, digits)
        open_to = np.isin(c["cell"], named[at]) & (c["id"] != q["id"][at])
        best = sorted((-s, i) for s, i in zip(sim[open_to], c["id"][open_to]))[:10]
        mine = got[got["query_id"] == q["id"][at]].sort_values(["similarity", "neighbor_id"], ascending=[False, True])
        assert np.allclose(mine["similarity"], [-s for s, _ in best], rtol=0, atol=1e-12)
        assert digits is None or mine["neighbor_id"].tolist() == [i for _, i in best]


def test_calibration_sends_no_vector_for_each_cell(spark, monkeypatch):
    """The places of a row's cells go without its vector, and rows meet all centres some at a time."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, rng.standard_normal(64).tolist()) for i in range(300)], VECTORS)
    index = ann.CellIndex.fit(df, n_cells=200, rounds=1)
    ran, plain_map = [], type(df).mapInArrow

    def seen(self, run, *more, **named):
        ran.append(run)
        return plain_map(self, run, *more, **named)

    monkeypatch.setattr(type(df), "mapInArrow", seen)
    assert index.calibrate(3, queries=50) <= len(index.centres)
    asked = pa.RecordBatch.from_pydict({"id": list(range(100)), "vec": rng.standard_normal((100, 64)).tolist()})
    places, = ran
    sent = list(places([asked]))
    assert sum(b.num_rows for b in sent) == 100 * len(index.centres)
    assert sum(b.nbytes for b in sent) <= 24 * 100 * len(index.centres)
    many = pa.RecordBatch.from_pydict({"id": list(range(5000))})
    assert [b.num_rows for b in ann._batched([many], np.zeros((2000, 1)))] == [524] * 9 + [284]
    assert [b.num_rows for b in ann._batched([many], np.zeros((10, 1)))] == [2048, 2048, 904]
