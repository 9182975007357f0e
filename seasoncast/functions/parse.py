"""Parsing and typing functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "col_of", "parse_vector", "rgb_channel", "parse_rgb", "parse_date", "date_column", "DATE_FORMATS",
    "bool_to_int", "fill_category", "season_key", "season_parts", "to_float32",
]

# Fixed date formats accepted by ``parse_date``: ISO first, then day-first.
# Written ISO dates are never re-read as day-first (the reference's swap bug).
DATE_FORMATS = ("yyyy-MM-dd", "d/M/yyyy")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_vector(c, sep: str = ",") -> Column:
    """``"f,f,..."`` -> array<double>; unparsable elements become null (F1)."""
    s = col_of(c)
    return F.transform(F.split(F.trim(s), sep), lambda x: F.trim(x).try_cast("double"))


def rgb_channel(c, i: int) -> Column:
    """Channel ``i`` of an ``"R,G,B"`` string; anything unparsable -> 0."""
    return F.coalesce(F.get(F.split(col_of(c), ","), i).try_cast("int"), F.lit(0))


def parse_rgb(c) -> list[Column]:
    """``"R,G,B"`` -> columns r, g, b (F2)."""
    return [rgb_channel(c, i).alias(n) for i, n in enumerate(("r", "g", "b"))]


def parse_date(c, formats=DATE_FORMATS) -> Column:
    """String -> date trying each fixed format; bad -> null."""
    s = col_of(c)
    return F.coalesce(*[F.try_to_date(s.cast("string"), f) for f in formats])


def date_column(df: DataFrame, c: str) -> Column:
    """A date from a column of any type: dates pass unchanged, timestamps are cut, texts are parsed."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.DateType):
        return F.col(c)
    return F.col(c).cast("date") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else parse_date(c)


def bool_to_int(c) -> Column:
    return col_of(c).cast("int")


def fill_category(c, token: str = "nan") -> Column:
    """Missing category -> literal token, everything as string."""
    return F.coalesce(col_of(c).cast("string"), F.lit(token))


def season_key(year="year", season="id_season") -> Column:
    """``year || '_' || season``."""
    return F.concat_ws("_", col_of(year).cast("string"), col_of(season).cast("string"))


def season_parts(c="season_year") -> list[Column]:
    """Split the season key back into integer year and season."""
    parts = F.split(col_of(c), "_")
    return [F.get(parts, 0).cast("int").alias("year_from_season"),
            F.get(parts, 1).cast("int").alias("season_id")]


def to_float32(c) -> Column:
    """Narrow cast to float32, only on request."""
    return col_of(c).cast("float")
