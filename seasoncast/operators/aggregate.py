"""Product and product-season aggregation.

Every roll-up is a single ``groupBy().agg()``: Spark plans a partial
aggregate before the shuffle, so a product holding a third of all rows is
combined map-side and never reaches one reducer whole.  "First value" uses
``min_by`` over an explicit order key (``first()`` is not deterministic after a
shuffle) and is itself partially aggregatable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasoncast.functions.measures import clipped_ratio, contains_any, safe_div
from seasoncast.functions.parse import parse_rgb, rgb_channel, season_key, season_parts

ORDER = ("year", "num_week_iso")

# Column groups of the reference's product-week schema.
CATEGORY_COLUMNS = ("aggregated_family", "family", "category", "fabric", "color_name", "length_type",
                    "silhouette_type", "neck_lapel_type", "sleeve_length_type", "print_type")
UNUSABLE_COLUMNS = ("waist_type", "woven_structure", "knit_structure", "archetype",
                    "heel_shape_type", "toecap_type")
SEASON_FIRST_COLUMNS = ("id_season", "aggregated_family", "family", "category", "fabric", "color_name",
                        "length_type", "silhouette_type", "waist_type", "sleeve_length_type",
                        "heel_shape_type", "toecap_type", "woven_structure", "knit_structure",
                        "print_type", "archetype", "moment", "ocassion", "phase_in", "phase_out")
OUTERWEAR_WORDS = ("Coat", "Jacket", "Outer")


def order_key(order: Sequence[str] = ORDER) -> Column:
    cols = [F.col(c) for c in order]
    return cols[0] if len(cols) == 1 else F.struct(*cols)


def first_non_null(c: str, order: Sequence[str] = ORDER, alias: str | None = None) -> Column:
    """First non-null value of ``c`` in ``order`` (N1): one output row may mix input rows."""
    ordering = F.when(F.col(c).isNotNull(), order_key(order))
    return F.min_by(F.col(c), ordering).alias(alias or c)


def with_order(df: DataFrame, order: Sequence[str] = ORDER) -> tuple[DataFrame, Sequence[str]]:
    """``df`` and the columns to order it by: two ints become one long, nulls first, that costs no struct a row and column.

    A null counts as the least int.
    """
    if len(order) != 2 or any(df.schema[c].dataType != T.IntegerType() for c in order):
        return df, order
    high, low = (F.coalesce(F.col(c), F.lit(-2 ** 31)).cast("long") for c in order)
    return df.withColumn("_order", F.shiftleft(high, 32).bitwiseOR(low + F.lit(2 ** 31))), ("_order",)


def season_target(panel: DataFrame, key: str = "ID", measure: str = "weekly_demand",
                  out: str = "target_demand") -> DataFrame:
    """Season target: sum of weekly demand per product; all-null sums to 0."""
    return (panel.where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.coalesce(F.sum(measure), F.lit(0.0)).alias(out)))


def product_first(panel: DataFrame, key: str = "ID", order: Sequence[str] = ORDER,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """One row per product with the first non-null value of every column (A2)."""
    cols = [c for c in (columns or panel.columns) if c != key]
    panel, order = with_order(panel, order)
    return (panel.where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(*[first_non_null(c, order) for c in cols]))


def product_table(panel: DataFrame, key: str = "ID", order: Sequence[str] = ORDER,
                  measure: str = "weekly_demand", target: str = "target_demand",
                  drop: Sequence[str] = UNUSABLE_COLUMNS + ("weekly_sales",)) -> DataFrame:
    """Product attributes joined to the season target (A1 + A2 + J1).

    The reference builds the target, the first-row table and then joins them;
    here both come from one aggregate, so there is no join and one shuffle.
    Order columns and the weekly measure leave the result, as in the reference.
    """
    gone = set(drop) | set(order) | {key, measure}
    attrs = [c for c in panel.columns if c not in gone]
    panel, order = with_order(panel, order)
    return (panel.where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(*[first_non_null(c, order) for c in attrs],
                 F.coalesce(F.sum(measure), F.lit(0.0)).alias(target)))


def ordered_mean(c: str) -> Column:
    """Mean summed in ascending value order: bit-identical whatever the partitioning.

    Only for groups of bounded size (a product-season has at most 53 weekly rows).
    """
    vals = F.array_sort(F.collect_list(F.col(c).cast("double")))
    return F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x) / F.size(vals)


def product_season(panel: DataFrame, key: str = "ID", order: Sequence[str] = ORDER,
                   season_cols: tuple[str, str] = ("year", "id_season")) -> DataFrame:
    """Product-season roll-up with ``<col>_<agg>`` names.

    Means of integer-valued measures are exact sum / count; the mean price (not
    integer-valued) is summed in value order so it is independent of the shuffle.
    """
    df = panel.withColumn("season_year", season_key(*season_cols))
    aggs: list[Column] = []
    for m in ("weekly_sales", "weekly_demand"):
        if m in df.columns:
            aggs += [F.sum(m).alias(f"{m}_sum"),
                     (F.sum(m) / F.count(m)).alias(f"{m}_mean"),
                     F.max(m).alias(f"{m}_max")]
    for m in ("Production", "num_stores", "num_sizes", "life_cycle_length"):
        if m in df.columns:
            aggs.append(F.max(m).alias(f"{m}_max"))
    if "price" in df.columns:
        aggs += [ordered_mean("price").alias("price_mean"),
                 F.max("price").alias("price_max"), F.min("price").alias("price_min")]
    if "color_rgb" in df.columns:
        for i, name in enumerate(("r", "g", "b")):
            ch = rgb_channel("color_rgb", i)
            aggs.append((F.sum(ch) / F.count(ch)).alias(f"color_{name}_mean"))
    aggs += [first_non_null(c, order, f"{c}_first") for c in SEASON_FIRST_COLUMNS if c in df.columns]
    return df.where(F.col(key).isNotNull()).groupBy(key, "season_year").agg(*aggs)


def color_mean(panel: DataFrame, key: str = "ID", season_cols=("year", "id_season")) -> DataFrame:
    """Mean colour channels per product-season (A6 with F2)."""
    r, g, b = parse_rgb("color_rgb")
    return (panel.select(key, season_key(*season_cols).alias("season_year"), r, g, b)
            .groupBy(key, "season_year")
            .agg(*[(F.sum(c) / F.count(c)).alias(f"color_{c}_mean") for c in ("r", "g", "b")]))


def season_features(ps: DataFrame) -> DataFrame:
    """Business ratios, intensities, time signals and flags."""
    out = ps.select(
        "*",
        clipped_ratio("weekly_sales_sum", "Production_max").alias("sell_through_ratio"),
        clipped_ratio("Production_max", "weekly_demand_sum").alias("demand_coverage_ratio"),
        safe_div("weekly_sales_sum", "life_cycle_length_max").alias("avg_sales_per_week_planned"),
        safe_div("weekly_demand_sum", "life_cycle_length_max").alias("avg_demand_per_week_planned"),
        safe_div("num_stores_max", "num_sizes_max").alias("stores_per_size"),
        *season_parts("season_year"),
    )
    if "aggregated_family_first" in ps.columns:
        out = out.withColumn("is_outerwear", contains_any("aggregated_family_first", OUTERWEAR_WORDS))
    if "moment_first" in ps.columns:
        out = out.withColumn("is_formal", contains_any("moment_first", ("Formal",)))
        out = out.withColumn("is_casual", contains_any("moment_first", ("Casual",)))
    return out


def season_history(ps: DataFrame, key: str = "ID") -> DataFrame:
    """Per-product season history (W1-W4): seasons ordered as integers, not strings.

    Windows are partitioned by product only; one product has few seasons, so a
    hot product never makes a large window partition.
    """
    if "year_from_season" not in ps.columns:
        ps = ps.select("*", *season_parts("season_year"))
    by_key = Window.partitionBy(key)
    ordered = by_key.orderBy("year_from_season", "season_id")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return ps.select(
        "*",
        F.count(F.lit(1)).over(by_key).cast("int").alias("n_seasons_per_id"),
        F.row_number().over(ordered).cast("int").alias("season_order_for_id"),
        F.round(F.coalesce(F.sum("Production_max").over(before), F.lit(0.0)), 4)
        .alias("cumulative_production_before"),
        F.coalesce(F.sum("weekly_demand_sum").over(before), F.lit(0.0)).alias("cumulative_demand_before"),
    )


def product_span(panel: DataFrame, key: str = "ID") -> DataFrame:
    """Weeks per product, week range and (first) production."""
    wk = F.col("year") * 100 + F.col("num_week_iso")
    return (panel.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n_weeks"),
                 F.min("num_week_iso").alias("min_week_iso"),
                 F.max("num_week_iso").alias("max_week_iso"),
                 F.min(wk).alias("first_week"),
                 F.max(wk).alias("last_week"),
                 first_non_null("Production", ORDER, "production_first")))
