"""Property tests for the rows-only operators (models, PCA, split, quantiles)."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from seasoncast.operators.models import boosting
from seasoncast.operators.models.features import PCAProjection
from seasoncast.operators.quantile import exact_quantiles


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 10, size=(600, 3))
    y = 3 * x[:, 0] + rng.exponential(5, size=600)
    rows = [(i, x[i].tolist(), float(y[i]), bool(i % 5 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double, is_val boolean")
    return df.withColumn("features", array_to_vector("x"))


def test_quantile_boosting_coverage_and_loss(spark, regression, tmp_path):
    m = boosting.fit_quantile_boosting(regression, alpha=0.8, n_rounds=12, learning_rate=0.3, max_depth=3,
                                       validation_col="is_val", patience=None, checkpoint_every=4)
    train_losses = [h[1] for h in m.history]
    assert train_losses[-1] < train_losses[0]
    pred = m.transform(regression.where(~F.col("is_val")))
    cover = pred.agg(F.avg((F.col("label") <= F.col("prediction")).cast("double"))).first()[0]
    assert 0.65 < cover < 0.95
    # reload gives identical scores
    path = str(tmp_path / "qgb")
    m.save(path)
    again = boosting.QuantileBoostingModel.load(path).transform(regression)
    a = {r["id"]: r["prediction"] for r in m.transform(regression).collect()}
    b = {r["id"]: r["prediction"] for r in again.collect()}
    assert a == b


def test_weighted_boosting_runs(spark, regression):
    df = regression.withColumn("w", F.lit(1.0) + (F.col("id") % 3))
    m = boosting.fit_quantile_boosting(df, alpha=0.65, n_rounds=3, max_depth=3, weight_col="w", patience=None)
    assert len(m.trees) == 3


def test_pca_orthonormal(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    p = PCAProjection(k=3).fit(df)
    c = p.components
    assert np.allclose(c.T @ c, np.eye(3), atol=1e-8)
    assert list(p.explained_variance) == sorted(p.explained_variance, reverse=True)
    proj = np.array([r["pca"] for r in p.transform(df).orderBy("id").collect()])
    assert np.allclose(proj.mean(axis=0), 0, atol=1e-9)


def test_exact_quantiles_skewed(spark):
    import duckdb
    import pandas as pd
    vals = [7.0] * 3000 + [float(i) for i in range(6000)]
    pdf = pd.DataFrame({"v": vals})
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, [("v", q) for q in (0.1, 0.333, 0.5, 0.995)], buckets=8, settle_rows=16)
    con = duckdb.connect()
    for q, g in zip((0.1, 0.333, 0.5, 0.995), got):
        assert g == con.sql(f"SELECT quantile_cont(v, {q}) FROM pdf").fetchall()[0][0]


def test_feature_subsampled_boosting_reload(spark, regression, tmp_path):
    m = boosting.fit_quantile_boosting(regression, alpha=0.8, n_rounds=4, max_depth=3, colsample=0.67,
                                       subsample=0.8, patience=None)
    assert all(s is not None and len(s) == 2 for s in m.feature_subsets)
    path = str(tmp_path / "qgb_fs")
    m.save(path)
    a = {r["id"]: r["prediction"] for r in m.transform(regression).collect()}
    b = {r["id"]: r["prediction"] for r in boosting.QuantileBoostingModel.load(path).transform(regression).collect()}
    assert a == b


def test_flags(spark):  # F13
    from seasoncast.functions.measures import contains_any
    df = spark.createDataFrame([("Formal wear",), ("CASUAL",), (None,), ("Outer jacket",)], "m string")
    got = [r[0] for r in df.select(contains_any("m", ("Formal",))).collect()]
    assert got == [1, 0, 0, 0]
    got = [r[0] for r in df.select(contains_any("m", ("Coat", "Jacket", "Outer"))).collect()]
    assert got == [0, 0, 0, 1]
