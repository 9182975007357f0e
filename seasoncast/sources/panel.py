"""Product x ISO-week panel derived from the order-line tables.

The reference's input is one row per (product, ISO year, ISO week) with weekly
sales/demand and repeated static product attributes.  The test tables carry the
same information as order lines, so the panel is a roll-up of ``lineitem``
joined to ``part``:

* two partial + final aggregations, first on (product, ISO year, ISO week,
  supplier), then on (product, ISO year, ISO week) — the lines of a hot
  product-week are spread over tasks by supplier, suppliers are counted rather
  than gathered, and the map side combine of the second step leaves a row per
  task;
* one exchange of the weekly rows on the product key alone, which satisfies the
  join to ``part`` (AQE turns it into a broadcast join at runtime when ``part``
  is small), the season-level window aggregates (partitioned by product, year, season) and every later
  per-product aggregate or window, so those plan no exchange of their own.

All money and quantity measures are built from exact integer sums and divided
once, so the values are reproducible across engines and partitionings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasoncast.sources.tables import table

PANEL_COLUMNS = [
    "ID", "year", "num_week_iso", "id_season", "weekly_sales", "weekly_demand", "Production",
    "price", "num_stores", "num_sizes", "has_plus_sizes", "aggregated_family", "family",
    "category", "color_name", "color_rgb", "phase_in", "phase_out", "life_cycle_length", "vec_id",
]


def weekly_lines(lineitem: DataFrame) -> DataFrame:
    """Order lines rolled up to (ID, ISO year, ISO week)."""
    q = F.col("l_quantity")
    week = ["ID", "year", "num_week_iso"]
    by_supplier = (
        lineitem.where(q > 0)
        .groupBy(
            F.col("l_partkey").alias("ID"),
            F.extract(F.lit("YEAROFWEEK"), F.col("l_shipdate")).cast("int").alias("year"),
            F.weekofyear("l_shipdate").cast("int").alias("num_week_iso"),
            "l_suppkey",
        )
        .agg(
            F.sum(q).alias("demand"),
            F.sum(F.when(F.col("l_returnflag") != "R", q).otherwise(F.lit(0.0))).alias("sales"),
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
            F.sum(q.cast("bigint")).alias("pieces"),
            F.min("l_shipdate").alias("first"),
            F.max("l_shipdate").alias("last"),
        )
    )
    return by_supplier.groupBy(*week).agg(
        F.sum("demand").alias("weekly_demand"),
        F.sum("sales").alias("weekly_sales"),
        (F.sum("cents").cast("double") / F.sum("pieces").cast("double") / 100).alias("price"),
        F.count("l_suppkey").cast("int").alias("num_stores"),
        F.min("first").cast("date").alias("first_day"),
        F.max("last").cast("date").alias("last_day"),
    )


def product_week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's training panel, one row per (ID, year, num_week_iso)."""
    weekly = weekly_lines(table(spark, sf_dir, "lineitem"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    n_vec = table(spark, sf_dir, "embeddings").select(F.count(F.lit(1))).scalar()

    season = Window.partitionBy("ID", "year", "id_season")
    ident = F.col("ID")
    # Hash-partition the weekly rows by product alone, before the attributes of the
    # product widen them: the join and the season windows below are satisfied by it, and so is every later per-product aggregate or window
    # (product table, product-season roll-up, history, sequences), which then
    # plan no exchange of their own.  A product has at most one row per week,
    # so even a very hot product makes a bounded partition here.
    weekly = weekly.repartition("ID")
    joined = (
        weekly.join(part, weekly["ID"] == part["p_partkey"], "inner")
        .withColumn("id_season", F.when(F.col("num_week_iso") <= 26, 1).otherwise(2).cast("int"))
    )
    phase_in = F.min("first_day").over(season)
    phase_out = F.max("last_day").over(season)
    return joined.select(
        ident,
        "year",
        "num_week_iso",
        "id_season",
        "weekly_sales",
        "weekly_demand",
        (F.sum("weekly_demand").over(season) * (F.lit(90) + ident % 5 * 5) / 100).alias("Production"),
        "price",
        "num_stores",
        (F.col("p_size") % 7 + 1).cast("int").alias("num_sizes"),
        (F.col("p_size") >= 40).alias("has_plus_sizes"),
        F.col("p_type").alias("aggregated_family"),
        F.col("p_brand").alias("family"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("category"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("color_name"),
        F.concat_ws(",", (ident % 256).cast("string"), (ident * 7 % 256).cast("string"),
                    (ident * 13 % 256).cast("string")).alias("color_rgb"),
        phase_in.alias("phase_in"),
        phase_out.alias("phase_out"),
        (F.floor(F.datediff(phase_out, phase_in) / 7) + 1).cast("int").alias("life_cycle_length"),
        (ident % n_vec).alias("vec_id"),
    )


# DuckDB form of the panel, used by the oracle SQL of every panel-based query.
PANEL_SQL = """
WITH w AS (
  SELECT l_partkey AS "ID",
         CAST(isoyear(l_shipdate) AS INTEGER) AS year,
         CAST(week(l_shipdate) AS INTEGER) AS num_week_iso,
         sum(l_quantity) AS weekly_demand,
         sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS weekly_sales,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
           / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100 AS price,
         CAST(count(DISTINCT l_suppkey) AS INTEGER) AS num_stores,
         CAST(min(l_shipdate) AS DATE) AS first_day,
         CAST(max(l_shipdate) AS DATE) AS last_day
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2, 3),
j AS (
  SELECT w.*, CAST(CASE WHEN w.num_week_iso <= 26 THEN 1 ELSE 2 END AS INTEGER) AS id_season,
         p.p_type, p.p_brand, p.p_name, p.p_size
  FROM w JOIN part p ON p.p_partkey = w."ID")
SELECT "ID", year, num_week_iso, id_season, weekly_sales, weekly_demand,
       sum(weekly_demand) OVER s * (90 + "ID" % 5 * 5) / 100 AS "Production",
       price, num_stores,
       CAST(p_size % 7 + 1 AS INTEGER) AS num_sizes, p_size >= 40 AS has_plus_sizes,
       p_type AS aggregated_family, p_brand AS family,
       split_part(p_name, ' ', 2) AS category, split_part(p_name, ' ', 1) AS color_name,
       concat(CAST("ID" % 256 AS VARCHAR), ',', CAST("ID" * 7 % 256 AS VARCHAR), ',',
              CAST("ID" * 13 % 256 AS VARCHAR)) AS color_rgb,
       min(first_day) OVER s AS phase_in, max(last_day) OVER s AS phase_out,
       CAST((max(last_day) OVER s - min(first_day) OVER s) // 7 + 1 AS INTEGER) AS life_cycle_length,
       "ID" % (SELECT count(*) FROM embeddings) AS vec_id
FROM j
WINDOW s AS (PARTITION BY "ID", year, id_season)
"""
