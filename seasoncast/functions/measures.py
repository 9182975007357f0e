"""Business measures, calendar and scaling expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from seasoncast.functions.parse import col_of

__all__ = [
    "season_weeks", "contains_any", "clipped_ratio", "safe_div",
    "months_between_days", "recency_weight", "life_cycle_projection", "planned_total_demand",
    "production_gap", "zscore", "unzscore", "embedding_width", "uplift",
]


def season_weeks(start, end) -> Column:
    """Season length in weeks as ``days / 7.0`` (F8)."""
    return F.datediff(col_of(end), col_of(start)) / 7.0


def contains_any(c, words) -> Column:
    """Case-insensitive substring flag, null -> 0."""
    pattern = "(?i)(" + "|".join(re.escape(w) for w in words) + ")"
    return F.coalesce(col_of(c).rlike(pattern), F.lit(False)).cast("int")


def clipped_ratio(num, den, lo: float = 0.0, hi: float = 2.0) -> Column:
    """``num / den`` clipped to [lo, hi] with the reference's division-by-zero
    outcomes: +x/0 -> hi, -x/0 -> lo, 0/0 -> null (F14, N9)."""
    n, d = col_of(num), col_of(den)
    return (F.when(d.isNull() | n.isNull(), F.lit(None).cast("double"))
            .when((d == 0) & (n > 0), F.lit(hi))
            .when((d == 0) & (n < 0), F.lit(lo))
            .when(d == 0, F.lit(None).cast("double"))
            .otherwise(F.least(F.greatest(n / d, F.lit(lo)), F.lit(hi))))


def safe_div(num, den) -> Column:
    """Division that yields null instead of an ANSI error on zero."""
    return F.try_divide(col_of(num), col_of(den)).cast("double")


def months_between_days(as_of, d) -> Column:
    """Age in 30-day months at ``as_of``, clipped at 0."""
    return F.greatest(F.datediff(col_of(as_of), col_of(d)) / 30.0, F.lit(0.0))


def recency_weight(months: Column, lam: float = 0.2) -> Column:
    """``exp(-lambda * months)``."""
    return F.exp(F.lit(-lam) * months)


def life_cycle_projection(start, end, rate) -> Column:
    """Days between two dates / 7 x weekly rate."""
    return F.datediff(col_of(end), col_of(start)) / 7.0 * col_of(rate)


def planned_total_demand(life_cycle="life_cycle_length", weekly="weekly_demand") -> Column:
    """Life cycle x weekly demand — the second 'total demand' definition."""
    return col_of(life_cycle) * col_of(weekly)


def production_gap(total: Column, production="Production") -> Column:
    return total - col_of(production)


def zscore(c, mean: Column, std: Column) -> Column:
    """``(x - mean) / std`` with std 0 treated as 1."""
    s = F.when(std == 0, F.lit(1.0)).otherwise(std)
    return (col_of(c) - mean) / s


def unzscore(c, mean: Column, std: Column) -> Column:
    s = F.when(std == 0, F.lit(1.0)).otherwise(std)
    return col_of(c) * s + mean


def embedding_width(n_classes) -> Column:
    """Factor width for a categorical of ``n`` classes: ``min(50, n // 2 + 1)``."""
    return F.least(F.lit(50), F.floor(col_of(n_classes) / 2) + 1).cast("int")


def uplift(c, factor: float = 1.1, floor: float | None = 0.0) -> Column:
    """Uniform uplift then optional clip at ``floor``."""
    x = col_of(c) * F.lit(factor)
    return x if floor is None else F.greatest(x, F.lit(floor))
