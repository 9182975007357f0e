"""Cosine k-nearest-neighbour join and the kNN regressor.

Exact search is a blocked matrix product:

* rows of each side are hash-assigned to blocks of some megabytes of vectors;
* every query block is paired with every corpus block through an equi-join on
  the block keys (``cogroup``), so one task sees one query block and one corpus
  block — memory per task is bounded by the block size, never by the corpus;
* inside the task a float64 GEMM scores the pair of blocks and only each
  query's local top-k leaves the task;
* a ``row_number() <= k`` window merges the candidates (Spark plans a partial
  ``WindowGroupLimit`` before the shuffle).

Rows with equal vectors are compared once: a vector stands for the rows that
have it, and of a corpus vector the first k + 1 ids are kept, more of them
cannot be among any row's k nearest.  The neighbours of a vector are then dealt
to its rows.  Tables whose ids repeat are compared row by row.

Shuffle volume is |Q| x corpus_blocks + |C| x query_blocks different vectors.  A
small corpus (one block) is shipped once to each query block, like a broadcast
join.
Neighbours are ranked by the rounded similarity and then by id, in the task and
in the merge, so equal vectors rank the same everywhere.  Vectors travel in
their own type (float32 stays float32) and are widened inside the task.  For
corpora where |Q| x |C| is too much, ``ann.CellIndex`` looks into the nearest
cells only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasoncast.session import materialise

PAIR_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("neighbor_id", T.LongType()),
    T.StructField("similarity", T.DoubleType()),
])


def _unit(vectors) -> np.ndarray:
    v = (vectors if isinstance(vectors, np.ndarray) else np.stack(vectors.to_numpy())).astype(np.float64)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _single(v: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Unit vectors in single precision, made some rows at a time."""
    out = np.empty(v.shape, np.float32)
    for at in range(0, len(v), rows):
        out[at:at + rows] = _unit(v[at:at + rows])
    return out


def _scored(units: np.ndarray, rows: np.ndarray, vectors: np.ndarray, cols: np.ndarray, pairs: int = 1 << 14) -> np.ndarray:
    """Cosines of pairs of a unit vector and a vector in double precision, some at a time."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), pairs):
        out[at:at + pairs] = np.einsum("nd,nd->n", units[rows[at:at + pairs]], _unit(vectors[cols[at:at + pairs]]))
    return out


def _narrow(sim: np.ndarray, kk: int, slack: float):
    """``(rows, columns)`` of all that can be among a row's best ``kk``, in any order; None if they are most of a block.

    The ``kk``-th largest of the maxima of slices of a row is a lower bound of
    its ``kk``-th similarity, found without ordering the row; only slices whose
    maximum reaches it are looked into.  What may not be met is below all others.
    """
    n = sim.shape[1]
    width = min(64, n // (4 * kk))
    if width < 2:
        return None
    step = n // width
    slices = sim[:, :step * width].reshape(len(sim), width, step)  # a slice is every ``step``-th column: its maximum runs along rows
    tops = slices.max(axis=1)
    bound = np.maximum(np.partition(tops, step - kk, axis=1)[:, step - kk], -2) - slack
    row, at = np.nonzero(tops >= bound[:, None])
    if 2 * len(row) > tops.size:
        return None
    hit, within = np.nonzero(slices[row, :, at] >= bound[row, None])
    last, over = np.nonzero(sim[:, step * width:] >= bound[:, None])
    rows, cols = np.concatenate([row[hit], last]), np.concatenate([within * step + at[hit], step * width + over])
    return (rows, cols) if len(rows) <= sim.size // 8 else None


def block_topk(k: int, exclude_self: bool, digits: int | None, chunk_bytes: int = 16 << 20):
    """Best ``k`` of a corpus block for every row of a query block, ties by id.

    Query rows are scored some at a time, so the similarities held are
    ``chunk_bytes`` whatever the block.  With the corpus in order of id, a row
    takes all that beat its k-th similarity and then the first that equal it.
    Only what can be among the best is rounded and ordered, unless ties or odd
    numbers make that most of the block.  If similarities are rounded, single
    precision finds what can be among the best, by more than its error, and
    that is scored in double precision; a block is widened as a whole only if
    it has to be scored so.

    If the query rows name ``cells``, each meets the corpus rows of these only:
    what no row of a chunk names is not scored, and the rest is left out by row,
    so no candidates are held for each row and cell.
    """
    def run(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(q) and len(c):
            c = c.sort_values("id", kind="stable")
            qv, cv = np.stack(q["vec"].to_numpy()), np.stack(c["vec"].to_numpy())
            qid, cid = q["id"].to_numpy(np.int64), c["id"].to_numpy(np.int64)
            step, every = max(1, chunk_bytes // (8 * len(cid))), np.arange(len(cid))
            slack = 0.0 if digits is None else 2.0 * 10.0 ** -digits
            q4, c4, whole = _single(qv), _single(cv), []
            plain = np.isfinite(q4).all() and np.isfinite(c4).all()
            single = plain and digits is not None
            if single:
                slack += 2 * (qv.shape[1] + 4) * 2.0 ** -23  # twice the error of a single-precision product of unit vectors, at most half of this

            named = q["cells"].to_numpy() if "cells" in q and q["cells"].iloc[0] is not None else None
            if named is not None:
                names, place = np.unique(c["cell"].to_numpy(), return_inverse=True)

            def open_to(at):
                """The corpus rows that some query row of a chunk may meet; of them, at minus infinity those that each may not."""
                asked = named[at:at + step]
                row, name = np.repeat(np.arange(len(asked)), [len(x) for x in asked]), np.concatenate(asked)
                found = np.minimum(np.searchsorted(names, name), len(names) - 1)
                here = names[found] == name
                shut = np.full((len(asked), len(names)), -np.inf, np.float32)
                shut[row[here], found[here]] = 0
                met = np.flatnonzero((shut == 0).any(axis=0)[place])
                met = met if 2 * len(met) < len(cid) else slice(None)
                return met, np.take(shut, place[met], axis=1)

            def scored(at, ids, met, shut, double):
                if double and not whole:
                    whole.append(_unit(cv))
                sim = _unit(qv[at:at + step]) @ whole[0][met].T if double else q4[at:at + step] @ c4[met].T
                if exclude_self:
                    sim[ids[:, None] == cid[None, met]] = -np.inf
                if shut is not None and plain:
                    sim += shut
                elif shut is not None:  # odd numbers would stay
                    sim[shut < 0] = -np.inf
                return sim

            for at in range(0, len(qid), step):
                ids = qid[at:at + step]
                met, shut = open_to(at) if named is not None else (slice(None), None)
                here = every[met]
                if not len(here):
                    continue
                kk = min(k, len(here))
                sim = scored(at, ids, met, shut, not single)
                near = _narrow(sim, kk, slack) if plain else None
                if near is not None:
                    rows, cols = near
                    value, cols = sim[rows, cols], here[cols]
                    if single:
                        kept = value > -np.inf  # not the row itself
                        rows, cols = rows[kept], cols[kept]
                        value = np.round(_scored(_unit(qv[at:at + step]), rows, cv, cols), digits)
                    order = np.lexsort((cols, -value, rows))
                    rows, cols, value = rows[order], cols[order], value[order]
                    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    keep = (nth < kk) & (value > -np.inf)
                    found.append((ids[rows[keep]], cid[cols[keep]], value[keep]))
                    continue
                if single:
                    sim = scored(at, ids, met, shut, True)
                if digits is not None:
                    np.round(sim, digits, out=sim)
                kth = np.partition(sim, len(here) - kk, axis=1)[:, len(here) - kk, None]
                over = sim > kth
                tied = sim == kth
                tied &= np.cumsum(tied, axis=1, dtype=np.int32) <= kk - over.sum(axis=1, keepdims=True)
                rows, cols = np.nonzero((over | tied) & (sim > -np.inf))
                found.append((ids[rows], cid[here[cols]], sim[rows, cols]))
        query, neighbor, similarity = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query_id": query, "neighbor_id": neighbor, "similarity": similarity})
    return run


def vectors_of(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)`` of the rows that have a vector."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("vec is not null")


def best_pairs(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidates of every query, ties by id, with their ``rank`` from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("neighbor_id"))
    ranked = candidates.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "neighbor_id", "rank", "similarity")


def unique_ids(*frames: DataFrame) -> bool:
    """Whether no frame has an ``id`` twice, or a row without one."""
    for df in frames:
        more = df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null")
        if more.limit(1).count():
            return False
    return True


def first_of_equals(rows: DataFrame, name: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """The different vectors of ``(id, vec)`` as ``(id, vec)`` with the least ``id`` that has each, and ``(id, first)`` of all rows.

    Equal vectors that differ in the columns ``by`` are different ones.  A
    vector as a sort or join key is brought into normal form at every
    comparison, so rows look for their vector by its hash, and compare if a hash
    has more than one.
    """
    keyed = rows.withColumn("hash", F.xxhash64("vec"))
    firsts = materialise(keyed.groupBy(*by, "hash", "vec").agg(F.min("id").alias("id")), f"{name}-vectors")
    if firsts.groupBy(*by, "hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        a, b = keyed.alias("a"), firsts.alias("b")
        same = ~(F.col("a.vec") < F.col("b.vec")) & ~(F.col("a.vec") > F.col("b.vec"))  # `=` would make the vectors a join key
    else:  # a hash names one vector, so the vectors need not move
        a, b, same = keyed.drop("vec").alias("a"), firsts.drop("vec").alias("b"), F.lit(True)
    met = F.col("a.hash") == F.col("b.hash")
    for c in by:
        met &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    members = a.join(b, met & same).select("a.id", F.col("b.id").alias("first"))
    return firsts.select("id", "vec", *by), materialise(members, f"{name}-members")


def least_ids(members: DataFrame, keep: int) -> DataFrame:
    """``(id, ids)``: the ``keep`` least ids, in order, of the rows that share the first row ``id``.

    Ids over ``keep`` go before the shuffle, so a vector that many rows have
    makes no large group.
    """
    order = Window.partitionBy("first").orderBy("id")
    least = members.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)
    return least.groupBy(F.col("first").alias("id")).agg(F.sort_array(F.collect_list(least["id"])).alias("ids"))


def deal_to_rows(near: DataFrame, asking: DataFrame, known: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """``(query_id, neighbor_id, rank, similarity)`` of all rows from the nearest vectors (by their least ids) of each vector.

    ``near`` has the best ``k`` vectors for each that is asked for, one more if
    rows are not their own neighbours; ``asking`` and ``known`` are the rows of
    both sides with their ``first``.
    """
    width = k + int(exclude_self)
    found = (near.select("query_id", F.col("neighbor_id").alias("id"), "similarity").join(least_ids(known, width), "id")
             .select("query_id", "similarity", F.explode("ids").alias("neighbor_id")))
    best = (best_pairs(found, width).groupBy(F.col("query_id").alias("first"))
            .agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "similarity"))).alias("best")))
    mine = asking.select(F.col("id").alias("query_id"), "first").join(best, "first")
    others = F.filter("best", lambda x: x["neighbor_id"] != F.col("query_id")) if exclude_self else F.col("best")
    return (mine.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "b"))
            .select("query_id", "b.neighbor_id", (F.col("at") + 1).cast("int").alias("rank"), "b.similarity"))


BLOCK_BYTES = 16 << 20  # vectors of one side of a block pair, as float64
MOST_PARTS = 4096       # partitions that block pairs are dealt over


def _blocks(n: int, block_rows: int) -> int:
    return max(1, math.ceil(n / block_rows))


def block_size(spark: SparkSession, nq: int, nc: int, width: int) -> int:
    """Vectors of a block: so many that every core has a pair of blocks, at most what ``BLOCK_BYTES`` hold."""
    cores = spark.sparkContext.defaultParallelism
    return min(max(1024, math.ceil(max(nq, nc) / (2 * math.sqrt(cores)))), max(1, BLOCK_BYTES // (8 * width)))


def knn_join(queries: DataFrame, corpus: DataFrame, k: int = 10, id_col: str = "id", vec_col: str = "vec",
             exclude_self: bool = True, block_rows: int | None = None, sim_digits: int | None = 9) -> DataFrame:
    """Exact top-k cosine neighbours of every query row in ``corpus``.

    Returns ``(query_id, neighbor_id, rank, similarity)``; ``rank`` starts at 1.
    Rows without a vector (null) neither ask nor answer; a vector of zeros is
    0 alike to all.  Blocks hold ``block_rows`` vectors, or so many that every core
    has a pair of blocks, at most what fits into ``BLOCK_BYTES`` by the width of
    the vectors.
    """
    q, c = vectors_of(queries, id_col, vec_col), vectors_of(corpus, id_col, vec_col)
    if not unique_ids(q, c):
        return best_pairs(_block_pairs(q, c, k, exclude_self, block_rows, sim_digits), k)
    width = k + int(exclude_self)
    asked, asking = first_of_equals(q, "knn-asked")
    known, answering = first_of_equals(c, "knn-known")
    near = best_pairs(_block_pairs(asked, known, width, False, block_rows, sim_digits), width)
    return deal_to_rows(near, asking, answering, k, exclude_self)


def _block_pairs(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, block_rows: int | None, sim_digits: int | None) -> DataFrame:
    """The best ``k`` of every corpus block for every query row, as ``PAIR_SCHEMA``."""
    # Sizes pick the block counts (two cheap jobs).
    (nq, dq), (nc, dc) = (df.agg(F.count("*"), F.max(F.size("vec"))).first() for df in (q, c))
    block_rows = block_rows or block_size(q.sparkSession, nq, nc, max(dq or 1, dc or 1))
    bq, bc = _blocks(nq, block_rows), _blocks(nc, block_rows)
    q = (q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(bq)).cast("int"))
         .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(bc - 1)))))
    c = (c.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(bc)).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1)))))
    # Few and costly pairs: by their bytes they would be put together until some cores have none.
    parts = min(4 * bq * bc, MOST_PARTS)
    q, c = q.repartition(parts, "qb", "cb"), c.repartition(parts, "qb", "cb")
    return (q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))
            .applyInPandas(block_topk(k, exclude_self, sim_digits), PAIR_SCHEMA))


class KnnIndex:
    """Fit once, query many times (E9): the corpus is normalised to unit length,
    tagged with its targets and materialised in the shared checkpoint folder."""

    def __init__(self, k: int = 10, id_col: str = "id", vec_col: str = "vec", block_rows: int | None = None):
        self.k, self.id_col, self.vec_col, self.block_rows = k, id_col, vec_col, block_rows
        self.corpus: DataFrame | None = None

    def fit(self, corpus: DataFrame) -> "KnnIndex":
        from seasoncast.functions.vectors import normalize
        from seasoncast.session import cut_lineage
        cols = [F.col(self.id_col).cast("long").alias("id"), normalize(self.vec_col).alias("vec")]
        self.corpus = cut_lineage(corpus.select(*cols))
        return self

    def kneighbors(self, queries: DataFrame, exclude_self: bool = False, sim_digits: int | None = 9) -> DataFrame:
        q = queries.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.vec_col).alias("vec"))
        return knn_join(q, self.corpus, k=self.k, exclude_self=exclude_self, block_rows=self.block_rows,
                        sim_digits=sim_digits)


def neighbor_weights(pairs: DataFrame, floor: float = 1e-6, digits: int | None = 9) -> DataFrame:
    """Similarities clipped at ``floor`` and normalised to sum 1 per query."""
    s = F.greatest(F.col("similarity"), F.lit(floor))
    w = s / F.sum(s).over(Window.partitionBy("query_id"))
    return pairs.withColumn("weight", F.round(w, digits) if digits is not None else w)


def knn_regress(weights: DataFrame, targets: DataFrame, id_col: str = "id", target_col: str = "target",
                out: str = "knn_pred", digits: int | None = 6) -> DataFrame:
    """kNN forecast = sum of weight x neighbour target per query (M6)."""
    t = targets.select(F.col(id_col).alias("neighbor_id"), F.col(target_col).alias("_y"))
    pred = (weights.join(t, "neighbor_id")
            .groupBy("query_id").agg(F.sum(F.col("weight") * F.col("_y")).alias(out)))
    return pred.withColumn(out, F.round(out, digits)) if digits is not None else pred


def neighbor_quantiles(pairs: DataFrame, targets: DataFrame, probs=(0.5, 0.9), id_col: str = "id",
                       target_col: str = "target", digits: int | None = 6) -> DataFrame:
    """Quantiles of the neighbours' targets per query (k rows per group, bounded)."""
    t = targets.select(F.col(id_col).alias("neighbor_id"), F.col(target_col).alias("_y"))
    aggs = []
    for p in probs:
        v = F.percentile(F.col("_y"), F.lit(p))
        aggs.append((F.round(v, digits) if digits is not None else v).alias(f"p{int(round(p * 100))}"))
    return pairs.join(t, "neighbor_id").groupBy("query_id").agg(*aggs)
