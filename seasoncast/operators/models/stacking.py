"""Stacked ensemble (M8): base forecasts on a hold-out -> ridge and comparison table -> bases refit on all rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.operators.blend import metrics_table, ridge_fit, ridge_predict
from seasoncast.session import materialise

Base = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]  # fit(train) -> predict(df) adding "prediction"


def level_one(df: DataFrame, bases: Mapping[str, Base], holdout_col: str = "is_val") -> DataFrame:
    """Hold-out rows with ``pred_<name>`` of every base fitted on the other rows, written once."""
    train, hold = df.where(~F.col(holdout_col)), df.where(F.col(holdout_col))
    for name, fit in bases.items():
        hold = fit(train)(hold).withColumnRenamed("prediction", f"pred_{name}")
    return materialise(hold, "level-one")


def compare_stack(level1: DataFrame, names, label: str = "label", alpha: float = 1.0, quantile: float = 0.8) -> DataFrame:
    """MAE, RMSE, pinball loss and mean residual of every base and of the ridge over them, a row a model."""
    columns = [f"pred_{n}" for n in names]
    scored = ridge_predict(level1, ridge_fit(level1, label, columns, alpha=alpha, digits=None), "stacked")
    table = metrics_table(scored, label, [*columns, "stacked"], alpha=quantile)
    bias = scored.agg(*[F.round(F.avg(F.col(label) - F.col(c)), 6).alias(c) for c in (*columns, "stacked")])
    return table.join(bias.unpivot([], [*columns, "stacked"], "model", "bias"), "model").withColumn("model", F.regexp_replace("model", "^pred_", ""))


def fit_stack(df: DataFrame, bases: Mapping[str, Base], label: str = "label", holdout_col: str = "is_val",
              alpha: float = 1.0, level1: DataFrame | None = None):
    """Returns ``predict(df) -> df + stacked`` and the ridge coefficients; ``level1`` as :func:`level_one` gave it."""
    level1 = level_one(df, bases, holdout_col) if level1 is None else level1
    coef = ridge_fit(level1, label, [f"pred_{n}" for n in bases], alpha=alpha, digits=None)
    full = {name: fit(df) for name, fit in bases.items()}    # refit every base on all rows

    def predict(x: DataFrame, out: str = "stacked") -> DataFrame:
        for name, pred in full.items():
            x = pred(x).withColumnRenamed("prediction", f"pred_{name}")
        return ridge_predict(x, coef, out)

    return predict, coef
