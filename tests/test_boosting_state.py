"""A fit stopped after any round and started again gives the trees of an uninterrupted one; weighted leaves are exact."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seasoncast.operators.models import boosting
from seasoncast.operators.quantile import weighted_quantiles
from seasoncast.plans import queries as q
from seasoncast.session import scratch_folder

SF = "/root/testdata/sf0.001"


def frame(spark):
    return q.model_frame(spark, SF, embedding=False).select("ID", "features", "label", "is_val")


SETTINGS = dict(alpha=0.8, max_depth=3, subsample=0.8, colsample=0.7, validation_col="is_val", patience=None)


def test_resumed_fit_is_the_whole_fit(spark, monkeypatch):
    rows = frame(spark).cache()
    whole = boosting.fit_quantile_boosting(rows, n_rounds=4, state=scratch_folder(spark, "whole"), **SETTINGS)
    folder = scratch_folder(spark, "stopped")
    commit, seen = boosting._Rounds.commit, []

    def failing(self, m, *rest):  # the driver dies while round 3 is being written
        if m == 3 and not seen:
            seen.append(m)
            rest[0].write.mode("overwrite").parquet(f"{self._at(m)}/rows")
            raise RuntimeError("lost")
        return commit(self, m, *rest)

    monkeypatch.setattr(boosting._Rounds, "commit", failing)
    with pytest.raises(RuntimeError):
        boosting.fit_quantile_boosting(rows, n_rounds=4, state=folder, **SETTINGS)
    again = boosting.fit_quantile_boosting(rows, n_rounds=4, state=folder, **SETTINGS)
    assert again.trees == whole.trees and again.feature_subsets == whole.feature_subsets
    assert len(again.history) == len(whole.history) == 5
    assert all(math.isclose(a, b, rel_tol=1e-9) for x, y in zip(again.history, whole.history) for a, b in zip(x, y))
    unsaved = boosting.fit_quantile_boosting(rows, n_rounds=4, **SETTINGS)
    assert unsaved.trees == whole.trees
    with pytest.raises(ValueError):
        boosting.fit_quantile_boosting(rows, n_rounds=4, state=folder, **{**SETTINGS, "alpha": 0.5})


def plain(rows, quantile):
    out = {}
    for g in {r[0] for r in rows}:
        mine = sorted((v, w) for k, v, w in rows if k == g and v is not None and not math.isnan(v) and w is not None and w > 0)
        total, upto = sum(w for _, w in mine), 0
        for v, w in mine:
            upto += w
            if upto >= quantile * total:
                out[g] = (total, v)
                break
    return out


@pytest.mark.parametrize("quantile", [0.0, 0.3, 0.65, 1.0])
def test_weighted_quantiles(spark, quantile):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.choice([rng.gauss(0, 1e3), 7.0, 1e-300, rng.random() * 1e-9]), rng.randrange(0, 9)) for _ in range(600)]
    rows += [("tie", 5.0, 3)] * 200 + [("tie", 6.0, 1), ("inf", math.inf, 5), ("inf", -math.inf, 5), ("inf", 0.0, 1), ("wide", 1.7e308, 1), ("wide", -1.7e308, 1),
             ("nan", math.nan, 4), ("nan", 1.0, 4), ("none", None, 3), ("light", 1.0, 0), ("only", math.inf, 2), ("", 3.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w long").repartition(4)
    for settings in (dict(buckets=4, settle_rows=5), dict(), dict(buckets=4, settle_rows=5, broadcast_groups=0)):
        got = {r["g"]: (r["weight"], r["quantile"]) for r in weighted_quantiles(df, ["g"], "v", "w", quantile, **settings).collect()}
        assert got == plain(rows, quantile)


def test_weighted_leaves_are_exact(spark):
    rows = frame(spark).withColumn("w", F.when(F.col("ID") % 3 == 0, 7).otherwise(1).cast("double")).cache()
    model = boosting.fit_quantile_boosting(rows, alpha=0.65, n_rounds=1, max_depth=2, validation_col="is_val", weight_col="w", patience=None)
    tree, init = model.trees[0], model.init
    leaves = {}
    for r in rows.where("not is_val").collect():
        at = 0
        while tree["feature"][at] >= 0:
            at = tree["left"][at] if r.features[tree["feature"][at]] <= tree["threshold"][at] else tree["right"][at]
        leaves.setdefault(at, []).append((at, r.label - init, r.w))
    assert len(leaves) > 1
    for at, mine in leaves.items():
        assert tree["value"][at] == plain(mine, 0.65)[at][1]
