"""Forecast joins, blends, uplift and evaluation.

All evaluation is one aggregate over the (forecast, truth) rows; the alpha grid
of the two-model blend is 21 aggregates of one pass over the rows, turned into
21 result rows afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _r(c: Column, digits: int | None) -> Column:
    return F.round(c, digits) if digits is not None else c


def join_forecasts(forecasts: Mapping[str, DataFrame], key: str = "ID", value: str = "Production") -> DataFrame:
    """Inner-join named forecast tables on the key: ``Production_<name>`` columns."""
    out = None
    for name, df in forecasts.items():
        d = df.select(key, F.col(value).alias(f"{value}_{name}"))
        out = d if out is None else out.join(d, key, "inner")
    return out


def mean_forecast(wide: DataFrame, cols: Sequence[str], key: str = "ID", out: str = "Production",
                  digits: int | None = 6) -> DataFrame:
    """Equal-weight ensemble per product (M9)."""
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return wide.select(key, _r(total / len(cols), digits).alias(out))


def pinball(y: Column, p: Column, alpha: float) -> Column:
    """Pinball (quantile) loss of one row."""
    e = y - p
    return F.greatest(F.lit(alpha) * e, F.lit(alpha - 1) * e)


def blend_grid(df: DataFrame, a: str, b: str, y: str, steps: int = 20, digits: int | None = 6) -> DataFrame:
    """MAE of ``alpha*a + (1-alpha)*b`` for alpha in {0, 1/steps, ..., 1}."""
    def mae(alpha):
        pred = F.lit(alpha) * F.col(a) + (1 - F.lit(alpha)) * F.col(b)
        return F.struct(F.lit(alpha).alias("alpha"), _r(F.avg(F.abs(F.col(y) - pred)), digits).alias("mae"))

    grid = df.agg(F.array(*[mae(i / steps) for i in range(steps + 1)]).alias("grid"))
    return grid.select(F.inline("grid")).where("mae is not null")


def best_alpha(grid: DataFrame) -> DataFrame:
    """Arg-min of the grid; the smallest alpha wins ties (O3)."""
    return grid.orderBy("mae", "alpha").limit(1)


def apply_blend(df: DataFrame, a: str, b: str, alpha: float, out: str = "Production") -> DataFrame:
    return df.withColumn(out, F.lit(alpha) * F.col(a) + (1 - F.lit(alpha)) * F.col(b))


def quantile_band(df: DataFrame, p50: str = "p50", p90: str = "p90", w50: float = 0.7,
                  out: str = "Production", digits: int | None = 6) -> DataFrame:
    """``0.7 * p50 + 0.3 * p90``."""
    return df.withColumn(out, _r(F.lit(w50) * F.col(p50) + F.lit(1 - w50) * F.col(p90), digits))


def metrics_table(df: DataFrame, y: str, preds: Sequence[str], alpha: float = 0.8,
                  digits: int | None = 6) -> DataFrame:
    """MAE, RMSE and pinball loss per model, one aggregate over stacked rows."""
    long = df.select(y, *preds).unpivot([y], list(preds), "model", "_p")
    e = F.col(y) - F.col("_p")
    return long.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        _r(F.avg(F.abs(e)), digits).alias("mae"),
        _r(F.sqrt(F.avg(e * e)), digits).alias("rmse"),
        _r(F.avg(pinball(F.col(y), F.col("_p"), alpha)), digits).alias("pinball"))


def ridge_fit(df: DataFrame, y: str, xs: Sequence[str], alpha: float = 1.0, digits: int | None = 6) -> DataFrame:
    """Ridge regression with an unpenalised intercept (M7).

    One aggregate returns the centred Gram matrix and cross products
    (``covar_pop``), a (p+1)^2-number result; the p x p solve runs on the
    driver.  Equals the textbook solution ``(Xc'Xc + alpha I)^-1 Xc'yc``.
    """
    xs = list(xs)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("my")] + [F.avg(x).alias(f"m_{x}") for x in xs]
    aggs += [F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if j >= i]
    aggs += [F.covar_pop(a, y).alias(f"cy_{i}") for i, a in enumerate(xs)]
    r = df.agg(*aggs).first()
    n, p = r["n"], len(xs)
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = r[f"c_{i}_{j}"] * n
    rhs = np.array([r[f"cy_{i}"] * n for i in range(p)])
    beta = np.linalg.solve(g + alpha * np.eye(p), rhs)
    intercept = r["my"] - sum(beta[i] * r[f"m_{x}"] for i, x in enumerate(xs))
    rows = [("intercept", float(intercept))] + [(x, float(b)) for x, b in zip(xs, beta)]
    coef = df.sparkSession.createDataFrame(rows, "term string, coef double")
    return coef.withColumn("coef", _r(F.col("coef"), digits))


def ridge_predict(df: DataFrame, coef: DataFrame, out: str = "Production") -> DataFrame:
    c = {r["term"]: r["coef"] for r in coef.collect()}  # p + 1 numbers
    pred = F.lit(c.pop("intercept"))
    for x, b in c.items():
        pred = pred + F.lit(b) * F.col(x)
    return df.withColumn(out, pred)


def early_stop(history: DataFrame, patience: int, metric: str = "val_loss", step: str = "round") -> DataFrame:
    """Best round of a validation history with patience.

    Training stops at the first round that is ``patience`` rounds past the
    running best; the answer is the best round up to that point."""
    from pyspark.sql import Window
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    h = history.withColumn("_best", F.min(metric).over(w))
    h = h.withColumn("_best_round", F.min_by(step, F.struct(metric, step)).over(w))
    stop = h.where(F.col(step) - F.col("_best_round") >= patience).agg(F.min(step)).scalar()
    upto = h.where(stop.isNull() | (F.col(step) <= stop))
    return upto.agg(F.min_by(step, F.struct(metric, step)).alias("best_round"),
                    F.min(metric).alias("best_loss"))
