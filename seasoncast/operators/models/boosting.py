"""Quantile gradient boosting on Spark.

MLlib's ``GBTRegressor`` offers squared and absolute loss only, so the
pinball-loss booster is a driver loop over distributed steps:

1. start from the alpha-quantile of the target (exact distributed selection);
2. each round, the negative pinball gradient (``alpha`` above the current
   forecast, ``alpha - 1`` at or below it) is the label of an MLlib
   ``DecisionTreeRegressor`` (optionally on a hash-based row sample);
3. each leaf's value is re-estimated as the alpha-quantile of the residuals of
   its training rows (``percentile_approx``, bounded memory however large a
   leaf is; with weights it is the exact weighted quantile, M5);
4. leaf values (at most ``2^depth`` per tree) become a literal map, so applying
   a tree in the loop is a projection, not a join; the finished model holds
   flattened trees and scores them all in one vectorised projection;
5. training and validation loss are one aggregate per round; early stopping
   keeps the best round (patience);
6. every ``checkpoint_every`` rounds the working frame is checkpointed into the
   shared checkpoint folder, which bounds the plan and survives executor loss;
7. with a ``state`` folder each round is committed there (trees, history, the
   rows with their forecast), and a fit that is started again on the same folder
   goes on after the last whole round.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from seasoncast.operators.blend import pinball
from seasoncast.operators.quantile import exact_quantile, weighted_quantiles
from seasoncast.session import cut_lineage, path_exists


def _map_literal(values: dict[int, float]) -> Column:
    items = []
    for k, v in sorted(values.items()):
        items += [F.lit(float(k)), F.lit(float(v))]
    return F.create_map(*items) if items else F.create_map().cast("map<double,double>")


def flatten_tree(tree: DecisionTreeRegressionModel, values: dict[int, float], subset: list[int] | None) -> dict:
    """A fitted tree as parallel lists; at most ``2^(depth + 1) - 1`` nodes.

    ``feature`` is -1 at a leaf; a row goes ``left`` if its feature value is at
    most ``threshold``.  ``value`` holds the re-estimated leaf values, which
    MLlib numbers in pre-order.
    """
    out = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}
    leaves = 0

    def add(node) -> int:
        nonlocal leaves
        at = len(out["feature"])
        for name, blank in (("feature", -1), ("threshold", 0.0), ("left", 0), ("right", 0), ("value", 0.0)):
            out[name].append(blank)
        if node.subtreeDepth() == 0:
            out["value"][at] = float(values.get(leaves, 0.0))
            leaves += 1
        else:
            split = node.split()
            index = split.featureIndex()
            out["feature"][at] = int(subset[index] if subset is not None else index)
            out["threshold"][at] = float(split.threshold())
            out["left"][at] = add(node.leftChild())
            out["right"][at] = add(node.rightChild())
        return at

    add(tree._java_obj.rootNode())
    return out


def _step(tree: dict, x: np.ndarray) -> np.ndarray:
    """Value of the leaf that every row of ``x`` ends in."""
    feature, threshold, left, right, value = (np.asarray(tree[k]) for k in ("feature", "threshold", "left", "right", "value"))
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while (feature[at] >= 0).any():
        inner = feature[at] >= 0
        down = np.where(x[rows, np.maximum(feature[at], 0)] <= threshold[at], left[at], right[at])
        at = np.where(inner, down, at)
    return value[at]


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


class _Rounds:
    """Committed rounds of a fit: ``round-m/rows`` is written before ``round-m/model``, whose _SUCCESS marks a whole round."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.settings = json.dumps(settings, sort_keys=True)
        if not path_exists(spark, f"{self.folder}/settings/_SUCCESS"):
            _write_text(spark, self.settings, f"{self.folder}/settings")
        elif spark.read.text(f"{self.folder}/settings").first()[0] != self.settings:
            raise ValueError(f"{folder} holds a fit with other settings")

    def _at(self, m: int) -> str:
        return f"{self.folder}/round-{m:05d}"

    def last(self) -> int:
        """Number of the last whole round, 0 if there is none."""
        m = 0
        while path_exists(self.spark, f"{self._at(m + 1)}/model/_SUCCESS"):
            m += 1
        return m

    def commit(self, m: int, rows: DataFrame, model: "QuantileBoostingModel") -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self._at(m)}/rows")
        _write_text(self.spark, json.dumps(asdict(model)), f"{self._at(m)}/model")
        return self.rows(m, rows.schema)

    def rows(self, m: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self._at(m)}/rows")

    def model(self, m: int) -> "QuantileBoostingModel":
        return QuantileBoostingModel.from_json(self.spark.read.text(f"{self._at(m)}/model").first()[0])


@dataclass
class QuantileBoostingModel:
    alpha: float
    learning_rate: float
    init: float
    trees: list = field(default_factory=list)            # flattened tree per round
    history: list = field(default_factory=list)          # (round, train_loss, val_loss)
    features_col: str = "features"
    feature_subsets: list = field(default_factory=list)  # per round: feature indices, or None for all

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Batch scoring (M13): one vectorised projection over all trees, however many."""
        init, rate = float(self.init), float(self.learning_rate)
        held = df.sparkSession.sparkContext.broadcast(self.trees)  # trees x 2^(depth + 1) numbers

        @F.pandas_udf("double")
        def score(features: pd.Series) -> pd.Series:
            x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, 1))
            total = np.full(len(x), init)
            for tree in held.value:
                total += rate * _step(tree, x)
            return pd.Series(total)

        return df.withColumn(out, score(vector_to_array(F.col(self.features_col))))

    def save(self, path: str) -> None:
        """Model folder: one JSON manifest with the flattened trees."""
        from pyspark.sql import SparkSession
        _write_text(SparkSession.getActiveSession(), json.dumps(asdict(self)), f"{path}/manifest")

    @classmethod
    def load(cls, path: str) -> "QuantileBoostingModel":
        from pyspark.sql import SparkSession
        return cls.from_json(SparkSession.getActiveSession().read.text(f"{path}/manifest").first()[0])

    @classmethod
    def from_json(cls, text: str) -> "QuantileBoostingModel":
        meta = json.loads(text)
        meta["history"] = [tuple(h) for h in meta["history"]]
        return cls(**meta)


def fit_quantile_boosting(df: DataFrame, label: str = "label", features: str = "features",
                          alpha: float = 0.8, n_rounds: int = 50, learning_rate: float = 0.1,
                          max_depth: int = 5, max_bins: int = 64, min_instances: int = 3,
                          subsample: float = 1.0, colsample: float = 1.0, patience: int | None = 10,
                          validation_col: str | None = None, weight_col: str | None = None,
                          checkpoint_every: int = 5, seed: int = 42, state: str | None = None) -> QuantileBoostingModel:
    """Fit the pinball-loss booster; ``validation_col`` marks hold-out rows (True).

    ``subsample`` keeps a hash-chosen share of training rows per round;
    ``colsample`` a seeded share of the features per tree (kept with the tree).
    ``state`` is a folder in shared storage for the rounds; a fit interrupted at
    any point and started again with it (and the same settings and rows) gives
    the trees of an uninterrupted one, and may ask for more rounds."""
    spark = df.sparkSession
    n_features = df.select(features).first()[0].size if colsample < 1.0 else 0
    val = F.col(validation_col) if validation_col else F.lit(False)
    base_cols = [features, label] + ([weight_col] if weight_col else [])
    rounds = None
    if state:
        rounds = _Rounds(spark, state, dict(alpha=alpha, learning_rate=learning_rate, max_depth=max_depth, max_bins=max_bins, min_instances=min_instances,
                                            subsample=subsample, colsample=colsample, weight_col=weight_col, seed=seed))
    done = rounds.last() if rounds else 0
    # The sample hashes the row's own values, so it is the same under any file layout.
    own = ["ID"] if "ID" in df.columns else [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType)]
    cur = df.select(*base_cols, val.alias("_val"), F.xxhash64(*own, F.lit(seed)).alias("_h"))
    if done:
        cur = rounds.rows(done, cur.withColumn("_f", F.lit(0.0)).schema).persist(StorageLevel.MEMORY_AND_DISK)
        model = rounds.model(done)
    else:
        cur = cut_lineage(cur)  # fixed rows and sample hash for the whole fit
        init = exact_quantile(cur.where(~F.col("_val")), label, alpha)
        cur = cur.withColumn("_f", F.lit(float(init))).persist(StorageLevel.MEMORY_AND_DISK)
        model = QuantileBoostingModel(alpha=alpha, learning_rate=learning_rate, init=init, features_col=features)
    stale = None  # the round before the current one: released once the current one is in the cache
    loss_expr = pinball(F.col(label), F.col("_f"), alpha)
    weight = F.col(weight_col) if weight_col else F.lit(1.0)
    best, best_round, since = float("inf"), 0, 0

    def judge(rounds_made: int, train_loss, val_loss) -> bool:
        """Keep the best number of trees; True when patience ran out."""
        nonlocal best, best_round, since
        score = val_loss if val_loss is not None else train_loss
        if score is not None and score < best - 1e-12:
            best, best_round, since = score, rounds_made, 0
        else:
            since += 1
        return patience is not None and since >= patience

    stopped = any([judge(*h) for h in model.history])
    for m in range(done, 0 if stopped else n_rounds):
        grad = F.when(F.col(label) > F.col("_f"), F.lit(alpha)).otherwise(F.lit(alpha - 1.0))
        work = cur.withColumn("_g", grad)
        train = work.where(~F.col("_val"))
        if subsample < 1.0:
            cut = int(subsample * 10_000)
            train = train.where(F.pmod(F.xxhash64("_h", F.lit(m)), F.lit(10_000)) < cut)
        subset = None
        tree_features = features
        if colsample < 1.0:
            k = max(1, int(round(colsample * n_features)))
            subset = sorted(int(i) for i in np.random.default_rng([seed, m]).choice(n_features, size=k, replace=False))
            tree_features = "_fs"
            train = VectorSlicer(inputCol=features, outputCol="_fs", indices=subset).transform(train)
        dt = DecisionTreeRegressor(featuresCol=tree_features, labelCol="_g", maxDepth=max_depth, maxBins=max_bins,
                                   minInstancesPerNode=min_instances, seed=seed + m, leafCol="_leaf",
                                   predictionCol="_pred")
        if weight_col:
            dt.setWeightCol(weight_col)
        tree = dt.fit(train)
        scored = work
        if subset is not None:
            scored = VectorSlicer(inputCol=features, outputCol="_fs", indices=subset).transform(work)
        leafed = tree.transform(scored).withColumn("_res", F.col(label) - F.col("_f"))
        # One job per round: leaf quantiles of the new tree (training rows) and
        # the loss of the model so far (all rows), by (split, leaf): <= 2 x 2^depth rows.
        stats = leafed.groupBy("_val", "_leaf").agg(
            F.percentile_approx("_res", alpha, 10000).alias("v"),
            F.sum(loss_expr * weight).alias("loss"), F.sum(weight).alias("n")).collect()
        if stale is not None:
            stale.unpersist()
            stale = None
        sums: dict = {}
        for r in stats:
            acc = sums.setdefault(r["_val"], [0.0, 0])
            acc[0] += r["loss"]
            acc[1] += r["n"]
        losses = {k: v[0] / v[1] for k, v in sums.items()}
        model.history.append((m, losses.get(False), losses.get(True)))
        if judge(*model.history[-1]):
            stopped = True
            break
        if weight_col:
            found = weighted_quantiles(leafed.where(~F.col("_val")), ["_leaf"], "_res", weight_col, alpha)
            values = {int(r["_leaf"]): r["quantile"] for r in found.collect()}  # at most 2^depth rows
        else:
            values = {int(r["_leaf"]): r["v"] for r in stats if not r["_val"]}
        model.trees.append(flatten_tree(tree, values, subset))
        model.feature_subsets.append(subset)
        step = F.coalesce(F.element_at(_map_literal(values), F.col("_leaf")), F.lit(0.0))
        nxt = leafed.select(*base_cols, "_val", "_h", (F.col("_f") + F.lit(learning_rate) * step).alias("_f"))
        if rounds:
            nxt = rounds.commit(m + 1, nxt, model).persist(StorageLevel.MEMORY_AND_DISK)
        elif checkpoint_every and (m + 1) % checkpoint_every == 0:
            nxt = cut_lineage(nxt)
        else:
            nxt = nxt.persist(StorageLevel.MEMORY_AND_DISK)
        stale, cur = cur, nxt
    if not stopped:
        final = cur.groupBy("_val").agg((F.sum(loss_expr * weight) / F.sum(weight)).alias("l")).collect()
        losses = {r["_val"]: r["l"] for r in final}
        model.history.append((len(model.trees), losses.get(False), losses.get(True)))
        judge(*model.history[-1])
    if stale is not None:
        stale.unpersist()
    cur.unpersist()
    if patience is not None:
        model.trees = model.trees[:best_round]
        model.feature_subsets = model.feature_subsets[:best_round]
    return model
