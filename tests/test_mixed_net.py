"""The pinball network: gradient, loss against a shifted factorisation machine, coverage, resumed and stored fits, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as ent
from seasoncast.operators.models import mixed_net
from seasoncast.operators.models.mixed_net import MixedNet, Shapes, rounded_pinball
from seasoncast.plans import queries as q
from seasoncast.session import scratch_folder


def test_gradient_is_the_slope_of_the_loss():
    rng, shapes = np.random.default_rng(1), Shapes([3, 5], [2, 3], 2, 4, 3, 6)
    flat = shapes.start(1) + 0.1 * rng.standard_normal(shapes.size)
    for i in range(2):
        shapes.split(flat)[f"c{i}"][-1] = 0
    c = np.stack([rng.integers(0, 3, 40), rng.integers(0, 5, 40)], axis=1)
    x, v, y = rng.standard_normal((40, 2)), rng.standard_normal((40, 4)), rng.standard_normal(40)
    f, kept = shapes.forward(shapes.split(flat), c, x, v)
    got = shapes.backward(shapes.split(flat), c, v, kept, -rounded_pinball(y - f, 0.8, 0.5)[1])
    loss = lambda p: rounded_pinball(y - shapes.forward(shapes.split(p), c, x, v)[0], 0.8, 0.5)[0].sum()
    unseen = {shapes.at[f"c{i}"].stop - 1 - k for i, w in enumerate([2, 3]) for k in range(w)}
    for i in range(shapes.size):
        step = np.zeros(shapes.size)
        step[i] = 1e-6
        slope = (loss(flat + step) - loss(flat - step)) / 2e-6
        assert abs(got[i] - (0.0 if i in unseen else slope)) < 1e-4


def test_rounded_corner_meets_the_pinball_loss():
    r = np.linspace(-2, 2, 401)
    loss, slope = rounded_pinball(r, 0.7, 0.5)
    plain = np.maximum(0.7 * r, -0.3 * r)
    assert np.allclose(loss[np.abs(r) >= 0.5], plain[np.abs(r) >= 0.5]) and np.all(loss >= plain - 1e-12)
    assert np.all(np.diff(slope) >= -1e-12) and np.isclose(loss[200], 0.125)


def small(spark, n=300):
    rng = np.random.default_rng(7)
    rows = [(i, ["a", "b", None][i % 3], float(x), [float(x), 1.0], float(3 * x + [0, 5, -5][i % 3] + rng.standard_normal()), i % 5 == 0)
            for i, x in enumerate(rng.standard_normal(n))]
    return spark.createDataFrame(rows, "ID long, c string, x double, v array<double>, label double, hold boolean").repartition(3)


def test_resumed_fit_takes_the_same_steps(spark, monkeypatch):
    rows, settings = small(spark), dict(categorical=["c"], numeric=["x"], embedding="v", steps=12, commit_every=4, patience=50)
    whole = MixedNet(**settings).fit(rows, "hold", state=scratch_folder(spark, "whole"))
    folder, commit, lost = scratch_folder(spark, "stopped"), MixedNet._commit, []

    def failing(self, spark_, state, now):
        commit(self, spark_, state, now)
        if now["step"] == 8 and not lost:
            lost.append(1)
            raise RuntimeError("lost")

    monkeypatch.setattr(MixedNet, "_commit", failing)
    with pytest.raises(RuntimeError):
        MixedNet(**settings).fit(rows, "hold", state=folder)
    again = MixedNet(**settings).fit(rows, "hold", state=folder)
    assert [h[0] for h in again.history] == [h[0] for h in whole.history]
    assert np.allclose(again.params, whole.params, atol=1e-6)
    with pytest.raises(ValueError):
        MixedNet(**{**settings, "alpha": 0.5}).fit(rows, "hold", state=folder)
    # stored and loaded, odd rows included: unseen and missing categories, missing numbers, extra columns
    loaded = MixedNet.load(spark, whole.save(scratch_folder(spark, "net")))
    odd = spark.createDataFrame([(1, "zzz", None, [0.0, 1.0], "q"), (2, None, 1.0, [0.0, 1.0], "r")], "ID long, c string, x double, v array<double>, extra string")
    a, b = (m.transform(odd).orderBy("ID").collect() for m in (whole, loaded))
    assert a == b and a[0].extra == "q" and all(np.isfinite(r.prediction) for r in a)
    assert loaded.transform(odd.where("ID > 5")).count() == 0


def test_numbers_alone(spark):
    net = MixedNet([], ["x"], steps=6).fit(small(spark, 60))
    assert net.shapes.vector == 0 and net.transform(small(spark, 60)).count() == 60
    assert mixed_net.STAGES[0] > mixed_net.STAGES[-1]


def test_beats_the_shifted_machine_and_covers(spark):
    sf = "/root/testdata/sf0.01"
    truth = q.products(spark, sf).where("not is_train").select("ID", F.col("target_demand").alias("y")).cache()

    def judged(name):
        r = F.col("y") - F.col("Production")
        got = ent.queries()[name](spark, sf).join(truth, "ID")
        return got.agg(F.avg(F.greatest(0.8 * r, -0.2 * r)).alias("loss"), F.avg((r <= 0).cast("int")).alias("cover")).first()

    net, machine = judged("net_pinball"), judged("fm_mixed")
    assert net["loss"] < machine["loss"]
    assert abs(net["cover"] - 0.8) <= 0.05
