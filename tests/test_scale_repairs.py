"""Conditions that only larger or odd data meet: replanned exchanges, non-finite values, file layouts, shared vectors."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasoncast.operators import aggregate, encode
from seasoncast.operators.models import boosting
from seasoncast.operators.quantile import exact_quantiles
from seasoncast.plans import queries as q
from seasoncast.sources.panel import product_week_panel

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("reuse,parts", [("true", 8), ("false", 8), ("false", 1), ("false", 64)])
def test_label_codes_are_dense_whatever_is_replanned(spark, reuse, parts):
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        n = 400_000
        df = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("a"), (F.col("id") % 7).cast("string").alias("b"))
        spec = encode.fit_label_dictionary(df, ["a", "b"])
        r = spec.where("column = 'a'").agg(F.count("*"), F.countDistinct("code"), F.min("code"), F.max("code")).first()
        assert tuple(r) == (n, n, 0, n - 1)
        wrong = spec.where("column = 'a'").selectExpr("value", "code", "lag(value) over (order by code) as before").where("value <= before")
        assert wrong.count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("extra", [[math.nan], [math.inf], [-math.inf, math.inf, math.nan], [1.7e308, -1.7e308], [1e-300, 1e300]])
def test_quantiles_end_on_non_finite_and_wide_values(spark, extra):
    values = [float(i * i % 997) for i in range(200)] + extra
    known = sorted(v for v in values if not math.isnan(v))
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for k in (0, 1, 50, 100, len(known) - 2, len(known) - 1):
        got, = exact_quantiles(df, [("x", k / (len(known) - 1))], buckets=8, settle_rows=8)
        assert math.isclose(got, known[k], rel_tol=1e-9) or got == known[k]
    only = spark.createDataFrame([(math.nan,), (None,)], "x double")
    assert exact_quantiles(only, [("x", 0.5)]) == [None]
    flat = spark.createDataFrame([(math.inf,)] * 30 + [(2.0,)], "x double")
    assert exact_quantiles(flat, [("x", 0.0), ("x", 0.9)], buckets=4, settle_rows=2) == [2.0, math.inf]


def test_panel_gathers_no_set(spark):
    plan = product_week_panel(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_every_product_has_a_forecast(spark):
    products = q.products(spark, SF).select("ID").collect()
    assert sorted(r.query_id for r in q.q_knn_forecast(spark, SF).collect()) == sorted(r.ID for r in products)
    held = q.products(spark, SF).where("not is_train").count()
    assert q.q_uplift_clip(spark, SF).count() == held


def _frame(spark, parts):
    rows = q.model_frame(spark, SF, embedding=False).select("ID", "features", "label", "is_val")
    return rows.repartition(parts, F.xxhash64("ID", F.lit(parts)))


def test_booster_agrees_under_any_layout_and_beats_a_constant(spark):
    models = [boosting.fit_quantile_boosting(_frame(spark, p), alpha=0.8, n_rounds=6, subsample=0.7, max_depth=3,
                                             validation_col="is_val", patience=None) for p in (1, 8)]
    scored = [{r.ID: r.prediction for r in m.transform(_frame(spark, 3)).collect()} for m in models]
    # the rows sampled are the same; sums in another order may still turn a split between equal gains
    assert all(math.isclose(a[1], b[1], rel_tol=0.01) for a, b in zip(models[0].history, models[1].history))
    assert statistics.mean(abs(scored[0][k] - scored[1][k]) for k in scored[0]) < 0.02 * statistics.mean(scored[0].values())
    rows = _frame(spark, 1).collect()
    train = [r.label for r in rows if not r.is_val]
    constant = statistics.quantiles(train, n=10)[7]
    loss = lambda y, p: max(0.8 * (y - p), -0.2 * (y - p))
    assert sum(loss(r.label, scored[0][r.ID]) for r in rows if not r.is_val) < sum(loss(y, constant) for y in train)
    cover = statistics.mean(r.label <= scored[0][r.ID] for r in rows if not r.is_val)
    assert 0.7 < cover < 0.9


def test_weighted_validation_loss_uses_the_weights(spark):
    frame = _frame(spark, 2).withColumn("w", F.when(F.col("ID") % 2 == 0, 5.0).otherwise(0.5))
    plain = boosting.fit_quantile_boosting(frame, alpha=0.65, n_rounds=2, max_depth=2, validation_col="is_val", patience=None)
    weighted = boosting.fit_quantile_boosting(frame, alpha=0.65, n_rounds=2, max_depth=2, validation_col="is_val", patience=None, weight_col="w")
    rows = frame.where("is_val").select("label", "w").collect()
    loss = lambda y, p: max(0.65 * (y - p), -0.35 * (y - p))
    want = sum(r.w * loss(r.label, weighted.init) for r in rows) / sum(r.w for r in rows)
    assert math.isclose(weighted.history[0][2], want, rel_tol=1e-9)
    assert not math.isclose(plain.history[0][2], want, rel_tol=1e-6)


def test_trained_ensemble_is_the_mean_of_its_files(spark):
    rows = q.q_ensemble_trained(spark, SF).collect()
    assert len(rows) == q.products(spark, SF).count()
    assert all(math.isclose(r.Production, (r.Production_band + r.Production_squared + r.Production_median) / 3, abs_tol=1e-5) for r in rows)


def test_long_model_scores_in_one_projection(spark):
    model = boosting.fit_quantile_boosting(_frame(spark, 2), alpha=0.8, n_rounds=2, max_depth=3, validation_col="is_val", patience=None)
    model.trees = model.trees * 100
    out = model.transform(_frame(spark, 2))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    step = [r.prediction for r in out.limit(3).collect()]
    assert len(step) == 3


def test_projection_from_its_stored_table_is_the_same(spark):
    from seasoncast.operators.models.features import PCAProjection
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    fitted = PCAProjection(k=3).fit(emb)
    again = PCAProjection.from_spec(fitted.spec(spark))
    a, b = ({r.vec_id: r.pca for r in p.transform(emb).collect()} for p in (fitted, again))
    assert a == b
    assert q.q_pca_boost(spark, SF).count() == q.products(spark, SF).count()


def test_numeric_profile_of_many_columns(spark):
    """Histogram entries become rows by compiled projections, moments a few columns at a time; the values are exact."""
    from seasoncast.operators import profile
    from seasoncast.operators.quantile import _long

    plan = _long(spark.range(3), [F.when(F.col("id") > i, F.struct(F.lit(i).alias("r"), F.col("id").alias("x"))) for i in range(2)])
    assert sorted((r["e"]["r"], r["e"]["x"]) for r in plan.collect()) == [(0, 1), (0, 2), (1, 2)]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in text and "lambda" not in text

    n, columns = 20_000, [f"c{i}" for i in range(2 * profile.PROFILE_COLUMNS + 1)]
    x = F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("double")
    rows = spark.range(n).select(*[F.when(F.col("id") % 7 != i, x * (i + 1) - 1000).alias(c) for i, c in enumerate(columns)])
    data = rows.toPandas()
    found = {r["column"]: r for r in profile.numeric_profile(rows).collect()}
    assert list(found) == columns
    for c in columns:
        v, r = data[c].dropna().to_numpy(), found[c]
        assert (r["count"], r["missing"], r["negatives"], r["zeros"]) == (len(v), n - len(v), (v < 0).sum(), (v == 0).sum())
        assert [r["min"], r["q25"], r["q50"], r["q75"], r["max"]] == np.quantile(v, [0, 0.25, 0.5, 0.75, 1]).tolist()
        assert abs(r["mean"] - v.mean()) < 1e-5 and abs(r["std"] - v.std()) < 1e-5


@pytest.mark.parametrize("name", ["gbt_categorical", "gbt_weighted"])
def test_trained_queries_roll_the_lines_up_once(spark, name, monkeypatch):
    """Fits and scoring read the written product table, not the order lines again."""
    import __spark_entry__ as ent

    calls, roll_up = [], q.product_week_panel
    monkeypatch.setattr(q, "product_week_panel", lambda *a: calls.append(1) or roll_up(*a))
    out = ent.queries()[name](spark, SF)
    assert len(calls) == 1
    assert not [f for f in out.inputFiles() if "lineitem" in f]


def test_panel_deals_weekly_rows_before_they_are_widened(spark):
    """The exchange by product comes below the join, so it doesn't carry the attributes of the product."""
    plan = product_week_panel(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("RepartitionByExpression")


def test_product_table_orders_by_one_number(spark):
    """No struct of year and week a row and column; weeks with a null come first and nulls are skipped, as before."""
    rows = [(1, 2000, 5, "b"), (1, 1999, 52, None), (1, 2000, 4, "a"), (1, 2001, 1, "c"), (2, None, 7, "x"), (2, 1990, 1, "y"),
            (3, None, None, "n"), (3, None, 3, "m"), (4, 1990, None, "p"), (4, 1990, -2, "q"), (5, -3, 1, "r"), (5, 3, 1, "s")]
    df = spark.createDataFrame(rows, "ID long, year int, num_week_iso int, family string").withColumn("weekly_demand", F.lit(1.0))
    table = aggregate.product_table(df)
    assert {r["ID"]: r["family"] for r in table.collect()} == {1: "a", 2: "x", 3: "n", 4: "p", 5: "r"}
    assert table.columns == ["ID", "family", "target_demand"]
    assert {r["ID"]: r["family"] for r in aggregate.product_first(df).collect()} == {1: "a", 2: "x", 3: "n", 4: "p", 5: "r"}
    assert "struct(year" not in table._jdf.queryExecution().executedPlan().toString()
