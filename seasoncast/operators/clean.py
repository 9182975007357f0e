"""Row filters and schema clean-up.

Filters are plain predicates, so Catalyst pushes them into the Parquet scan
(``PushedFilters``) and drops unused columns (``ReadSchema``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasoncast.operators.quantile import exact_quantile
from seasoncast.session import cut_lineage


def drop_if_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop columns, ignoring absent ones."""
    return df.drop(*[c for c in cols if c in df.columns])


def drop_prefixed(df: DataFrame, prefix: str = "Unnamed") -> DataFrame:
    """Drop CSV artefact columns such as ``Unnamed: 28``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith(prefix)])


def keep_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the listed columns that exist, in list order."""
    return df.select(*[c for c in cols if c in df.columns])


def select_by_type(df: DataFrame, include=None, exclude=(T.StringType,)) -> DataFrame:
    """Keep columns by data type, e.g. drop text columns before profiling."""
    def keep(f):
        if include is not None and not isinstance(f.dataType, tuple(include)):
            return False
        return not isinstance(f.dataType, tuple(exclude or ()))
    return df.select(*[f.name for f in df.schema.fields if keep(f)])


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "input") -> DataFrame:
    """Plan-time required-column check (P5)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {len(missing)} required column(s): {', '.join(missing)}")
    return df


def check_vector_width(df: DataFrame, col: str, dim: int) -> DataFrame:
    """Rows whose vector width differs from ``dim`` (P6); checks every row, not row 0."""
    return df.where(F.size(col) != F.lit(dim))


def reindex_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Reorder to a training schema; absent columns become typed nulls."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def column_difference(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns of ``left`` missing from ``right`` (P8), sorted."""
    return sorted(set(left.columns) - set(right.columns))


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns (P10)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def equals(df: DataFrame, col: str, value) -> DataFrame:
    """Equality filter."""
    return df.where(F.col(col) == F.lit(value))


def drop_null_keys(df: DataFrame, key: str = "ID") -> DataFrame:
    """Drop rows with a null key."""
    return df.where(F.col(key).isNotNull())


def non_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop negative values but keep nulls."""
    cond: Column = F.lit(True)
    for c in cols:
        if c in df.columns:
            cond = cond & (F.col(c).isNull() | (F.col(c) >= 0))
    return df.where(cond)


def trim_upper(df: DataFrame, col: str, q: float = 0.995) -> DataFrame:
    """Keep rows with ``col <= quantile(col, q)``; nulls are dropped.

    The threshold is an exact distributed quantile (see ``quantile.py``) over
    the one column; the rows themselves are only filtered.
    """
    upper = exact_quantile(df, col, q)
    if upper is None:
        return df.where(F.lit(False))
    return df.where(F.col(col) <= F.lit(upper))


MEASURES = ("weekly_sales", "weekly_demand", "Production")


def clean_panel(panel: DataFrame, key: str = "ID", measures: Sequence[str] = MEASURES,
                trim_col: str = "Production", q: float = 0.995, materialize: bool = False) -> DataFrame:
    """Cleaning of the reference notebook: null keys, negatives, top outliers.

    The trim needs one column of the filtered rows ahead of the rows themselves;
    ``materialize`` writes the rows once to the shared folder, for upstream plans
    that cost more than writing them."""
    df = non_negative(drop_null_keys(panel, key), measures)
    if trim_col in df.columns:
        if materialize:
            df = cut_lineage(df)
        df = trim_upper(df, trim_col, q)
    return df
