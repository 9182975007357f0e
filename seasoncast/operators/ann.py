"""Approximate cosine neighbours by cells: spherical k-means, cells as a partitioned table, probes per query.

* :meth:`CellIndex.fit` runs spherical k-means as Spark jobs: centres are
  broadcast (their number is bounded by ``centre_bytes``), tasks send one sum a
  centre, whatever their rows.  It may fit on a bounded share of the corpus,
  chosen by a hash of the id; every row is indexed.
* The corpus is written once, in folders by cell.  A cell of over ``part_rows``
  rows is split into parts.  A search packs parts into bins of a block's size,
  so no task sees more than a bin and about a block of queries, however uneven the cells are.
* :meth:`CellIndex.calibrate` finds how many cells have to be probed: for some
  rows the exact neighbours are computed, and the places of their cells among
  the row's nearest ones tell the share that any number of probes finds.
* :meth:`CellIndex.search` compares a query with the rows of its ``probes``
  nearest cells, block by block with the kernel of the exact join.  With all
  cells probed the answer is the exact one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasoncast.operators.similarity import MOST_PARTS, PAIR_SCHEMA, best_pairs, block_size, block_topk, deal_to_rows, first_of_equals, knn_join, unique_ids, vectors_of
from seasoncast.session import materialise, path_exists, scratch_folder

_SHARE = 1 << 30
_HELD = 1 << 20  # similarities of rows and centres held at once


def _units(column: pa.ListArray) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _nearest(units: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the ``probes`` centres most alike to every row, best first, ties by number."""
    sim = np.round(units @ centres.T, 9)
    if probes == 1:
        return sim.argmax(axis=1)[:, None]
    return np.argsort(-sim, axis=1, kind="stable")[:, :probes]


def _batched(batches, centres: np.ndarray):
    """Slices of so many rows that their similarities to all centres stay bounded."""
    rows = max(1, min(2048, _HELD // max(len(centres), 1)))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _cell_sums(held):
    def run(batches):
        centres = held.value
        total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in _batched(batches, centres):
            units = _units(batch.column(0))
            cell = _nearest(units, centres, 1)[:, 0]
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.diff(cell[order], prepend=-1))
            total[cell[order][first]] += np.add.reduceat(units[order], first)
            n += np.bincount(cell, minlength=len(n))
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen]), pa.array(list(total[seen]), pa.list_(pa.float64()))], ["cell", "n", "total"])
    return run


def _into_cells(held):
    """Every row with its nearest cell: ``id, vec, cell``."""
    def run(batches):
        centres = held.value
        for batch in _batched(batches, centres):
            cell = _nearest(_units(batch.column(1)), centres, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], ["id", "vec", "cell"])
    return run


def _places(held):
    """A row for each row and cell, without the vector: ``id, cell, probe``."""
    def run(batches):
        centres = held.value
        probe = np.arange(len(centres), dtype=np.int32)
        for batch in _batched(batches, centres):
            cells = _nearest(_units(batch.column(1)), centres, len(centres))
            row = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(cells.ravel().astype(np.int32)), pa.array(np.tile(probe, batch.num_rows))],
                                             ["id", "cell", "probe"])
    return run


def _into_bins(held, probes: int):
    """A row for each row and bin that holds some of its probed cells: ``id, vec, bin, cells``."""
    def run(batches):
        centres, first, last = held.value
        for batch in _batched(batches, centres):
            cells = _nearest(_units(batch.column(1)), centres, probes)
            row, cell = np.repeat(np.arange(batch.num_rows), cells.shape[1]), cells.ravel()
            n = last[cell] - first[cell] + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, cell, into = np.repeat(row, n), np.repeat(cell, n), np.repeat(first[cell], n) + at
            order = np.lexsort((cell, into, row))
            row, cell, into = row[order], cell[order], into[order]
            new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(into, prepend=-1) != 0))
            ends = pa.array(np.append(new, len(row)).astype(np.int32))
            source = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(source), batch.column(1).take(source), pa.array(into[new].astype(np.int32)),
                                              pa.ListArray.from_arrays(ends, pa.array(cell.astype(np.int32)))], ["id", "vec", "bin", "cells"])
    return run


def _bin_topk(k: int, exclude_self: bool, digits: int | None):
    """Best ``k`` of a bin's rows for every query, each query in the cells that it names only; no names, all cells."""
    best = block_topk(k, exclude_self, digits)

    def run(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if len(q) and q["cells"].iloc[0] is not None:
            q = q.iloc[np.argsort([x[0] for x in q["cells"]], kind="stable")]  # rows that name the same cells are scored together
        return best(key, q, c)
    return run


class CellIndex:
    """A fitted index: ``cells`` (written table ``id, vec, cell, part``), ``sizes`` (``cell, n, parts``) and the centres."""

    def __init__(self, path: str, cells: DataFrame, sizes: DataFrame, centres: np.ndarray, part_rows: int):
        self.path, self.cells, self.sizes, self.centres, self.part_rows = path, cells, sizes, centres, part_rows
        self.probes: int | None = None

    def calibrate(self, k: int = 10, recall: float = 0.97, queries: int = 512) -> int:
        """Least number of probes that finds ``recall`` of the exact ``k`` neighbours of ``queries`` indexed rows, kept for :meth:`search`.

        The rows are those of the lowest hashes of their ids; each looks for its
        neighbours among all others.  An equal vector in a nearer cell counts.
        """
        if not len(self.centres):
            return 1
        spark = self.cells.sparkSession
        drawn = materialise(self.cells.select("id", "vec").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(queries), "ann-queries")
        exact = knn_join(drawn, self.cells, k=k)
        held = spark.sparkContext.broadcast(self.centres)
        places = drawn.mapInArrow(_places(held), "id long, cell int, probe int")
        near = exact.join(self.cells.select(F.col("id").alias("neighbor_id"), "cell"), "neighbor_id")
        met = near.join(places.select(F.col("id").alias("query_id"), "cell", "probe"), ["query_id", "cell"])
        needed = met.groupBy("probe").count().orderBy("probe").collect()  # at most a row a centre
        wanted, seen = recall * sum(r["count"] for r in needed), 0
        self.probes = len(self.centres)
        for r in needed:
            seen += r["count"]
            if seen >= wanted:
                self.probes = r["probe"] + 1
                break
        spark.createDataFrame([(self.probes, k, float(recall))], "probes int, k int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/probes")
        return self.probes

    @classmethod
    def fit(cls, corpus: DataFrame, n_cells: int | None = None, rounds: int = 6, part_rows: int = 4096, train_rows: int = 1 << 20,
            centre_bytes: int = 64 << 20, id_col: str = "id", vec_col: str = "vec", path: str | None = None) -> "CellIndex":
        """Fit on at most about ``train_rows`` rows and index all rows that have a vector.

        ``n_cells`` is the square root of the corpus by default, at most what
        ``centre_bytes`` hold and the distinct vectors that the start is drawn from.
        """
        spark = corpus.sparkSession
        rows = materialise(vectors_of(corpus, id_col, vec_col), "ann-rows")
        n, width, least = rows.agg(F.count("*"), F.max(F.size("vec")), F.min(F.size("vec"))).first()
        if width != least:
            raise ValueError(f"vectors of {least} to {width} entries")
        path = path or scratch_folder(spark, "cell-index")
        limit = max(1, centre_bytes // (8 * max(width or 1, 1)))
        wanted = min(n_cells or round(math.sqrt(n)), n, limit)
        centres = cls._start(rows, wanted, width or 1)
        share = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(_SHARE)) < int(min(1.0, train_rows / max(n, 1)) * _SHARE)
        sample = rows.where(share).select("vec").coalesce(4 * spark.sparkContext.defaultParallelism)
        for _ in range(rounds if len(centres) > 1 else 0):
            held = spark.sparkContext.broadcast(centres)
            sums = sample.mapInArrow(_cell_sums(held), "cell long, n long, total array<double>")
            moved = sums.groupBy("cell").applyInPandas(
                lambda p: pd.DataFrame({"cell": p["cell"].iloc[:1], "n": [p["n"].sum()], "total": [np.sum(np.stack(p["total"].to_numpy()), axis=0)]}), sums.schema)
            centres = centres.copy()
            for r in moved.collect():  # at most a row a centre
                total = np.array(r["total"])
                if np.linalg.norm(total) > 0:
                    centres[r["cell"]] = total / np.linalg.norm(total)
        held = spark.sparkContext.broadcast(centres)
        vec = rows.schema["vec"].dataType.simpleString()
        placed = materialise(rows.mapInArrow(_into_cells(held), f"id long, vec {vec}, cell int"), "ann-placed")
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int"))
        sizes.write.parquet(f"{path}/sizes")
        sizes = spark.read.parquet(f"{path}/sizes")
        split = (placed.join(F.broadcast(sizes.select("cell", "parts")), "cell")  # at most a row a centre
                 .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts"))
        split.repartition("cell", "part").sortWithinPartitions("cell", "part").write.partitionBy("cell").parquet(f"{path}/cells")
        table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
        table.withColumn("part_rows", F.lit(part_rows)).coalesce(1).write.parquet(f"{path}/centres")
        return cls.load(spark, path)

    @staticmethod
    def _start(rows: DataFrame, wanted: int, width: int) -> np.ndarray:
        """The first ``wanted`` distinct directions among four times as many rows of the lowest hashes."""
        drawn = rows.select("id", "vec").orderBy(F.xxhash64("id", F.lit(3)), "id").limit(4 * wanted)
        vectors = drawn.toArrow().column("vec").combine_chunks() if wanted else pa.array([], pa.list_(pa.float64()))
        units = np.round(_units(vectors), 12) if len(vectors) else np.zeros((0, width))
        _, first = np.unique(units, axis=0, return_index=True)
        return units[np.sort(first)[:wanted]] if len(units) else np.zeros((0, width))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CellIndex":
        centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        cells = spark.read.parquet(f"{path}/cells").select("id", "vec", F.col("cell").cast("int").alias("cell"), "part") if centres else None
        out = cls(path, cells, spark.read.parquet(f"{path}/sizes"), np.array([r["centre"] for r in centres]), centres[0]["part_rows"] if centres else 1)
        if path_exists(spark, f"{path}/probes/_SUCCESS"):
            out.probes = spark.read.parquet(f"{path}/probes").first()["probes"]
        return out

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exclude_self: bool = False, sim_digits: int | None = 9,
               id_col: str = "id", vec_col: str = "vec") -> DataFrame:
        """``(query_id, neighbor_id, rank, similarity)``: the best ``k`` of the ``probes`` cells nearest to every query
        (as calibrated, else 8).

        The result has the shape of ``similarity.knn_join``; queries without a vector are left out.
        """
        spark = queries.sparkSession
        if not len(self.centres):
            return spark.createDataFrame([], PAIR_SCHEMA).selectExpr("query_id", "neighbor_id", "cast(0 as int) as rank", "similarity")
        q = vectors_of(queries, id_col, vec_col)
        cells = self.cells.select("id", "vec", "cell", "part")
        if not unique_ids(q, cells):
            return best_pairs(self._probe(q, cells, k, probes, exclude_self, sim_digits), k)
        # Equal vectors lie in one cell and are compared once, as in the exact join.
        width = k + int(exclude_self)
        asked, asking = first_of_equals(q, "ann-asked")
        known, answering = first_of_equals(cells.select("id", "vec", "cell"), "ann-known", "cell")
        parts = F.broadcast(self.sizes.select("cell", "parts"))
        placed = known.join(parts, "cell").select("id", "vec", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        near = best_pairs(self._probe(asked, placed, width, probes, False, sim_digits), width)
        return deal_to_rows(near, asking, answering, k, exclude_self)

    def _probe(self, q: DataFrame, cells: DataFrame, k: int, probes: int | None, exclude_self: bool, sim_digits: int | None) -> DataFrame:
        """The best ``k`` of every bin for every query row, from the probed cells alone.

        The parts of the cells are packed into bins of a block's size, and a query
        goes to a bin once, with the numbers of the cells that it probes there.
        """
        spark = q.sparkSession
        probes = min(probes or self.probes or 8, len(self.centres))
        nq, dq = q.agg(F.count("*"), F.max(F.size("vec"))).first()
        held_in = cells.groupBy("cell").agg(F.count("*").alias("n")).join(self.sizes.select("cell", "parts"), "cell").orderBy("cell").collect()  # at most a row a centre
        if not nq or not held_in:
            return spark.createDataFrame([], PAIR_SCHEMA)
        rows = block_size(spark, nq, sum(r["n"] for r in held_in), max(dq, self.centres.shape[1]))
        start = np.cumsum([0] + [r["n"] for r in held_in]).tolist()
        table = [(r["cell"], at, r["n"], r["parts"]) for r, at in zip(held_in, start)]
        bins = (start[-1] - 1) // rows + 1
        first, last = np.zeros(len(self.centres), np.int64), np.full(len(self.centres), -1, np.int64)  # a cell that holds nothing: no bin
        for cell, at, n, parts in table:
            first[cell], last[cell] = at // rows, (at + (parts - 1) * n // parts) // rows
        vec = q.schema["vec"].dataType.simpleString()
        if probes == len(self.centres):
            asked = q.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(None).cast("array<int>").alias("cells"))
            blocks = spark.createDataFrame([(b, math.ceil(nq / rows)) for b in range(bins)], "bin int, blocks int")
        else:
            held = spark.sparkContext.broadcast((self.centres, first, last))
            asked = materialise(q.mapInArrow(_into_bins(held, probes), f"id long, vec {vec}, bin int, cells array<int>"), "ann-probes")
            counts = asked.groupBy("bin").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks")).collect()  # at most a row a bin
            blocks = spark.createDataFrame([tuple(r) for r in counts], "bin int, blocks int")
        places = spark.createDataFrame(table, "cell int, start long, n long, parts long")
        c = (cells.join(F.broadcast(places), "cell").withColumn("bin", F.expr(f"(start + (part * n) div parts) div {rows}").cast("int"))
             .join(F.broadcast(blocks), "bin").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("bin", "block", "cell", "id", "vec"))
        a = (asked.join(F.broadcast(blocks), "bin").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .select("bin", "block", "cells", "id", "vec"))
        key = ["bin", "block"]
        parts = min(4 * bins * math.ceil(nq / rows), MOST_PARTS)  # dealt as in the exact join
        a, c = a.repartition(parts, *key), c.repartition(parts, *key)
        return a.groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(_bin_topk(k, exclude_self, sim_digits), PAIR_SCHEMA)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, exact neighbours, and how many as good ones were found.

    An answer is as good as an exact one if it is at least as alike as the last
    of these (equal vectors are common, and any of them will do).
    """
    least = exact.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
    good = approximate.join(least, "query_id").where(F.col("similarity") >= F.col("least")).groupBy("query_id").agg(F.count("*").alias("good"))
    return (least.join(good, "query_id", "left")
            .agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_neighbors"), F.sum(F.least("n", F.coalesce("good", F.lit(0)))).alias("n_found")))
