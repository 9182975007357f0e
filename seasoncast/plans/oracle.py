"""DuckDB statements that recompute each registered query independently.

They start from the same Parquet views and rebuild the panel in SQL
(``PANEL_SQL``), so a match checks the whole Spark plan, not just its tail.
"""

from __future__ import annotations

from seasoncast.operators.aggregate import SEASON_FIRST_COLUMNS
from seasoncast.sources.panel import PANEL_COLUMNS, PANEL_SQL

ORACLE: dict[str, str] = {}

ORDER_KEY = "year * 100 + num_week_iso"


def with_panel(body: str) -> str:
    return f"WITH panel AS ({PANEL_SQL})\n{body}"


def first_sql(c: str, alias: str | None = None) -> str:
    return f'arg_min("{c}", {ORDER_KEY}) FILTER (WHERE "{c}" IS NOT NULL) AS "{alias or c}"'


ORACLE["panel"] = with_panel("SELECT * FROM panel")

ORACLE["season_target"] = with_panel(
    'SELECT "ID", coalesce(sum(weekly_demand), 0.0) AS target_demand FROM panel '
    'WHERE "ID" IS NOT NULL GROUP BY "ID"')

ORACLE["product_first"] = with_panel(
    "SELECT \"ID\", " + ", ".join(first_sql(c) for c in PANEL_COLUMNS if c != "ID")
    + ' FROM panel WHERE "ID" IS NOT NULL GROUP BY "ID"')

_PT_ATTRS = [c for c in PANEL_COLUMNS
             if c not in ("ID", "year", "num_week_iso", "weekly_demand", "weekly_sales")]
PRODUCT_TABLE_SQL = ("SELECT \"ID\", " + ", ".join(first_sql(c) for c in _PT_ATTRS)
                     + ', coalesce(sum(weekly_demand), 0.0) AS target_demand'
                     + ' FROM panel WHERE "ID" IS NOT NULL GROUP BY "ID"')
ORACLE["product_table"] = with_panel(PRODUCT_TABLE_SQL)

_RGB = ", ".join(f"coalesce(TRY_CAST(split_part(color_rgb, ',', {i + 1}) AS INTEGER), 0) AS {n}"
                 for i, n in enumerate("rgb"))
_PS_FIRST = [c for c in SEASON_FIRST_COLUMNS if c in PANEL_COLUMNS]
PRODUCT_SEASON_SQL = f"""
SELECT "ID", season_year,
  sum(weekly_sales) AS weekly_sales_sum, sum(weekly_sales) / count(weekly_sales) AS weekly_sales_mean,
  max(weekly_sales) AS weekly_sales_max,
  sum(weekly_demand) AS weekly_demand_sum, sum(weekly_demand) / count(weekly_demand) AS weekly_demand_mean,
  max(weekly_demand) AS weekly_demand_max,
  max("Production") AS "Production_max", max(num_stores) AS num_stores_max,
  max(num_sizes) AS num_sizes_max, max(life_cycle_length) AS life_cycle_length_max,
  list_reduce(list_sort(list(price)), lambda acc, x: acc + x) / count(price) AS price_mean, max(price) AS price_max, min(price) AS price_min,
  sum(r) / count(r) AS color_r_mean, sum(g) / count(g) AS color_g_mean, sum(b) / count(b) AS color_b_mean,
  {", ".join(first_sql(c, c + "_first") for c in _PS_FIRST)}
FROM (SELECT *, concat(CAST(year AS VARCHAR), '_', CAST(id_season AS VARCHAR)) AS season_year, {_RGB}
      FROM panel) t
WHERE "ID" IS NOT NULL
GROUP BY "ID", season_year"""

ORACLE["product_season"] = with_panel(PRODUCT_SEASON_SQL)

ORACLE["color_mean"] = with_panel(f"""
SELECT "ID", season_year, sum(r) / count(r) AS color_r_mean, sum(g) / count(g) AS color_g_mean,
       sum(b) / count(b) AS color_b_mean
FROM (SELECT "ID", concat(CAST(year AS VARCHAR), '_', CAST(id_season AS VARCHAR)) AS season_year, {_RGB}
      FROM panel) t
GROUP BY "ID", season_year""")


def clipped_ratio_sql(n: str, d: str, lo: float = 0.0, hi: float = 2.0) -> str:
    return (f"CASE WHEN {d} IS NULL OR {n} IS NULL THEN NULL WHEN {d} = 0 AND {n} > 0 THEN {hi} "
            f"WHEN {d} = 0 AND {n} < 0 THEN {lo} WHEN {d} = 0 THEN NULL "
            f"ELSE least(greatest({n} / {d}, {lo}), {hi}) END")


def safe_div_sql(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN NULL ELSE CAST({n} AS DOUBLE) / {d} END"


SEASON_FEATURES_SQL = f"""
SELECT ps.*,
  {clipped_ratio_sql('weekly_sales_sum', '"Production_max"')} AS sell_through_ratio,
  {clipped_ratio_sql('"Production_max"', 'weekly_demand_sum')} AS demand_coverage_ratio,
  {safe_div_sql('weekly_sales_sum', 'life_cycle_length_max')} AS avg_sales_per_week_planned,
  {safe_div_sql('weekly_demand_sum', 'life_cycle_length_max')} AS avg_demand_per_week_planned,
  {safe_div_sql('num_stores_max', 'num_sizes_max')} AS stores_per_size,
  CAST(split_part(season_year, '_', 1) AS INTEGER) AS year_from_season,
  CAST(split_part(season_year, '_', 2) AS INTEGER) AS season_id,
  CAST(coalesce(regexp_matches(aggregated_family_first, '(?i)(Coat|Jacket|Outer)'), false) AS INTEGER)
    AS is_outerwear
FROM ps"""


SEASON_HISTORY_SQL = """
SELECT sf.*,
  CAST(count(*) OVER (PARTITION BY "ID") AS INTEGER) AS n_seasons_per_id,
  CAST(row_number() OVER (PARTITION BY "ID" ORDER BY year_from_season, season_id) AS INTEGER)
    AS season_order_for_id,
  round(coalesce(sum("Production_max") OVER h, 0.0), 4) AS cumulative_production_before,
  coalesce(sum(weekly_demand_sum) OVER h, 0.0) AS cumulative_demand_before
FROM sf
WINDOW h AS (PARTITION BY "ID" ORDER BY year_from_season, season_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def season_ctes() -> str:
    return (f"WITH panel AS ({PANEL_SQL}), ps AS ({PRODUCT_SEASON_SQL}), "
            f"sf AS ({SEASON_FEATURES_SQL})\n")


ORACLE["season_features"] = season_ctes() + "SELECT * FROM sf"
ORACLE["season_history"] = season_ctes() + SEASON_HISTORY_SQL

ORACLE["product_span"] = with_panel(f"""
SELECT "ID", count(*) AS n_weeks, min(num_week_iso) AS min_week_iso, max(num_week_iso) AS max_week_iso,
       min({ORDER_KEY}) AS first_week, max({ORDER_KEY}) AS last_week,
       {first_sql("Production", "production_first")}
FROM panel GROUP BY "ID\"""")

ORACLE["demand_gap"] = with_panel("""
SELECT "ID", year, num_week_iso, life_cycle_length * weekly_demand AS total_demand,
       life_cycle_length * weekly_demand - "Production" AS production_gap
FROM panel""")


# --- cleaning and profiling -------------------------------------------------
CLEAN_SQL = """
f AS (SELECT * FROM panel WHERE "ID" IS NOT NULL
      AND (weekly_sales IS NULL OR weekly_sales >= 0) AND (weekly_demand IS NULL OR weekly_demand >= 0)
      AND ("Production" IS NULL OR "Production" >= 0)),
clean AS (SELECT * FROM f WHERE "Production" <= (SELECT quantile_cont("Production", 0.995) FROM f))"""
ORACLE["clean_panel"] = f"WITH panel AS ({PANEL_SQL}), {CLEAN_SQL}\nSELECT * FROM clean"

ORACLE["value_counts"] = with_panel('SELECT "ID", count(*) AS count FROM panel GROUP BY "ID"')
ORACLE["top_values"] = with_panel(
    "SELECT family, count(*) AS count FROM panel GROUP BY family ORDER BY count DESC, family LIMIT 10")
ORACLE["top_products"] = with_panel(
    'SELECT "ID", coalesce(sum(weekly_demand), 0.0) AS target_demand FROM panel WHERE "ID" IS NOT NULL '
    'GROUP BY "ID" ORDER BY target_demand DESC, "ID" LIMIT 20')
ORACLE["shape"] = with_panel(f"SELECT count(*) AS n_rows, {len(PANEL_COLUMNS)} AS n_cols FROM panel")

ORACLE["distinct_counts"] = with_panel("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT \"{c}\") AS n_unique FROM panel" for c in PANEL_COLUMNS))


def _constant_sql(c: str) -> str:
    return f'(SELECT max(n) = 1 FROM (SELECT count(DISTINCT "{c}") AS n FROM panel GROUP BY "ID"))'


ORACLE["constant_per_key"] = with_panel("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {_constant_sql(c)} AS \"is_constant_per_ID\"" for c in PANEL_COLUMNS))

_SPARK_TYPE = ("CASE any_value(typeof({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
               "WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' "
               "WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(any_value(typeof({c}))) END")
ORACLE["column_profile"] = with_panel("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {_SPARK_TYPE.format(c=chr(34) + c + chr(34))} AS dtype, "
    f"CAST(count_if(\"{c}\" IS NULL) AS BIGINT) AS missing, count(DISTINCT \"{c}\") AS \"unique\", "
    f"arg_min(CAST(\"{c}\" AS VARCHAR), (year, num_week_iso, \"ID\")) FILTER (WHERE \"{c}\" IS NOT NULL) AS example, "
    f"{_constant_sql(c)} AS \"is_constant_per_ID\" FROM panel" for c in PANEL_COLUMNS))

NUMERIC_PANEL = ["ID", "year", "num_week_iso", "id_season", "weekly_sales", "weekly_demand", "Production",
                 "price", "num_stores", "num_sizes", "life_cycle_length", "vec_id"]


def numeric_profile_sql(cols, src="panel", quantiles=(0.25, 0.5, 0.75)) -> str:
    parts = []
    for c in cols:
        x = f'CAST("{c}" AS DOUBLE)'
        qs = ", ".join(f"quantile_cont({x}, {q}) AS q{int(round(q * 100)):02d}" for q in quantiles)
        parts.append(
            f"SELECT '{c}' AS \"column\", count(\"{c}\") AS count, CAST(count_if(\"{c}\" IS NULL) AS BIGINT) AS missing, "
            f"round(avg({x}), 6) AS mean, round(stddev_pop({x}), 6) AS std, min({x}) AS min, "
            f"max({x}) AS max, CAST(count_if(\"{c}\" = 0) AS BIGINT) AS zeros, "
            f"CAST(count_if(\"{c}\" < 0) AS BIGINT) AS negatives, {qs} "
            f"FROM {src}")
    return "\nUNION ALL\n".join(parts)


ORACLE["numeric_profile"] = with_panel(numeric_profile_sql(NUMERIC_PANEL))

_SPLIT = ('l AS (SELECT DISTINCT "ID" FROM panel WHERE year < 2000), '
          'r AS (SELECT DISTINCT "ID" FROM panel WHERE year >= 2000)')
ORACLE["key_overlap"] = f"""WITH panel AS ({PANEL_SQL}), {_SPLIT}
SELECT count(l."ID") AS n_left, count(r."ID") AS n_right,
       CAST(count_if(l."ID" IS NOT NULL AND r."ID" IS NOT NULL) AS BIGINT) AS n_both,
       CAST(count_if(l."ID" IS NOT NULL AND r."ID" IS NULL) AS BIGINT) AS n_left_only,
       CAST(count_if(l."ID" IS NULL AND r."ID" IS NOT NULL) AS BIGINT) AS n_right_only
FROM l FULL OUTER JOIN r ON l."ID" = r."ID\""""
ORACLE["keys_intersect"] = f'WITH panel AS ({PANEL_SQL}), {_SPLIT}\nSELECT "ID" FROM l INTERSECT SELECT "ID" FROM r'
ORACLE["keys_except"] = f"""WITH panel AS ({PANEL_SQL}), {_SPLIT}
(SELECT "ID", 'left_only' AS side FROM (SELECT "ID" FROM l EXCEPT SELECT "ID" FROM r))
UNION ALL
(SELECT "ID", 'right_only' AS side FROM (SELECT "ID" FROM r EXCEPT SELECT "ID" FROM l))"""


# --- feature specs ----------------------------------------------------------
PRODUCTS_SQL = ("SELECT *, substr(md5(concat(CAST(\"ID\" AS VARCHAR), ':42')), 1, 8) < 'cccccccc' AS is_train "
                f"FROM ({PRODUCT_TABLE_SQL}) t0")


def products_ctes() -> str:
    return f"WITH panel AS ({PANEL_SQL}), pt AS ({PRODUCTS_SQL})\n"


CATS = ["aggregated_family", "family", "category", "color_name", "color_rgb"]
DICT_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
    f"FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'nan') AS v FROM pt WHERE is_train)" for c in CATS)

ORACLE["split_holdout"] = products_ctes() + 'SELECT "ID", is_train FROM pt'
ORACLE["label_dictionary"] = products_ctes() + DICT_SQL


def _encoded(c: str, clamp: bool = False) -> str:
    n = f"(SELECT count(*) FROM dict WHERE \"column\" = '{c}')"
    unk = f"(SELECT max(code) FROM dict WHERE \"column\" = '{c}' AND value = 'UNKNOWN')"
    code = (f"coalesce((SELECT code FROM dict WHERE \"column\" = '{c}' "
            f"AND value = coalesce(CAST(pt.{c} AS VARCHAR), 'nan')), {unk}, {n})")
    return f"CAST(least({code}, {n} - 1) AS INTEGER)" if clamp else f"CAST({code} AS INTEGER)"


ORACLE["label_encode_unseen"] = (
    f"WITH panel AS ({PANEL_SQL}), pt AS ({PRODUCTS_SQL}), dict AS ({DICT_SQL})\n"
    "SELECT \"ID\", " + ", ".join(f"{_encoded(c)} AS {c}" for c in CATS)
    + f", {_encoded('color_rgb', True)} AS color_rgb_clamped FROM pt")

ORACLE["date_offsets"] = products_ctes() + """SELECT "ID",
  CAST(coalesce(date_diff('day', (SELECT min(phase_in) FROM pt WHERE is_train), phase_in), 0) AS DOUBLE) AS phase_in,
  CAST(coalesce(date_diff('day', (SELECT min(phase_out) FROM pt WHERE is_train), phase_out), 0) AS DOUBLE) AS phase_out
FROM pt"""

ORACLE["calendar_features"] = products_ctes() + """SELECT "ID",
  CAST(month(phase_in) AS INTEGER) AS phase_in_month, CAST(week(phase_in) AS INTEGER) AS phase_in_week,
  CAST(month(phase_out) AS INTEGER) AS phase_out_month, CAST(week(phase_out) AS INTEGER) AS phase_out_week,
  date_diff('day', phase_in, phase_out) / 7.0 AS season_weeks
FROM pt"""

SCALED = ["price", "num_stores", "num_sizes", "life_cycle_length", "target_demand"]
_STATS = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}"
                   for c in SCALED)
ORACLE["zscore"] = (products_ctes().rstrip("\n") + f", st AS (SELECT {_STATS} FROM pt WHERE is_train)\n"
                    + "SELECT \"ID\", " + ", ".join(
                        f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END, 6) AS {c}"
                        for c in SCALED) + " FROM pt, st")

ORACLE["recency_weight"] = products_ctes() + """SELECT "ID",
  round(exp(-0.2 * greatest(date_diff('day', phase_out, DATE '2002-01-01') / 30.0, 0.0)), 9) AS sample_weight
FROM pt"""


# --- similarity and blending --------------------------------------------------
KNN_CTES = f"""WITH panel AS ({PANEL_SQL}), pt AS ({PRODUCTS_SQL}),
items AS (SELECT pt."ID" AS id, e.vec_id, pt.target_demand AS target, pt.family, pt.is_train
          FROM embeddings e JOIN pt USING (vec_id)),
vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
cosines AS MATERIALIZED (SELECT a.vec_id AS v1, b.vec_id AS v2, round(list_cosine_similarity(a.vec, b.vec), 9) AS sim
                         FROM vecs a, vecs b),
pairs AS (SELECT q.id AS query_id, c.id AS neighbor_id, sim
          FROM items q JOIN cosines ON v1 = q.vec_id JOIN items c ON c.vec_id = v2 AND c.is_train AND c.id <> q.id),
topk AS (SELECT query_id, neighbor_id, CAST(rank AS INTEGER) AS rank, sim AS similarity FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbor_id) AS rank FROM pairs)
         WHERE rank <= 10),
wts AS (SELECT *, round(greatest(similarity, 1e-6) / sum(greatest(similarity, 1e-6)) OVER (PARTITION BY query_id), 9)
          AS weight FROM topk),
knn AS (SELECT query_id, round(sum(weight * i.target), 6) AS knn_pred FROM wts JOIN items i ON i.id = wts.neighbor_id
        GROUP BY query_id),
fam AS (SELECT family, sum(target) / count(target) AS family_mean FROM items WHERE is_train GROUP BY family),
gm AS (SELECT sum(target) / count(target) AS global_mean FROM items WHERE is_train),
bf AS (SELECT i.id, i.target, i.family, i.is_train, knn.knn_pred,
              coalesce(fam.family_mean, gm.global_mean) AS family_mean, gm.global_mean
       FROM items i JOIN knn ON knn.query_id = i.id LEFT JOIN fam ON fam.family = i.family, gm),
grid AS (SELECT alpha, round(avg(abs(target - (alpha * family_mean + (1 - alpha) * knn_pred))), 6) AS mae
         FROM bf, (SELECT i / 20.0 AS alpha FROM range(0, 21) t(i)) a WHERE is_train GROUP BY alpha)
"""

ORACLE["knn_topk"] = KNN_CTES + "SELECT * FROM topk"
ORACLE["knn_weights"] = KNN_CTES + "SELECT query_id, neighbor_id, weight FROM wts"
ORACLE["knn_forecast"] = KNN_CTES + "SELECT * FROM knn"
ORACLE["forecast_mean"] = KNN_CTES + (
    'SELECT id AS "ID", round((knn_pred + family_mean + global_mean) / 3, 6) AS "Production" FROM bf')
ORACLE["blend_grid"] = KNN_CTES + "SELECT * FROM grid"
ORACLE["blend_best"] = KNN_CTES + "SELECT * FROM grid ORDER BY mae, alpha LIMIT 1"
ORACLE["uplift_clip"] = KNN_CTES + """, best AS (SELECT alpha FROM grid ORDER BY mae, alpha LIMIT 1)
SELECT id AS "ID", round(greatest((best.alpha * family_mean + (1 - best.alpha) * knn_pred) * 1.1, 0.0), 6)
  AS "Production" FROM bf, best WHERE NOT is_train"""
ORACLE["quantile_band"] = KNN_CTES + """, q AS (
  SELECT query_id, round(quantile_cont(i.target, 0.5), 6) AS p50, round(quantile_cont(i.target, 0.9), 6) AS p90
  FROM topk JOIN items i ON i.id = topk.neighbor_id GROUP BY query_id)
SELECT query_id AS "ID", p50, p90, round(0.7 * p50 + 0.3 * p90, 6) AS "Production" FROM q"""
ORACLE["metrics_table"] = KNN_CTES + """, ho AS (
  SELECT target, knn_pred, family_mean, global_mean, (knn_pred + family_mean + global_mean) / 3 AS mean3
  FROM bf WHERE NOT is_train),
long AS (UNPIVOT ho ON knn_pred, family_mean, global_mean, mean3 INTO NAME model VALUE p)
SELECT model, count(*) AS n, round(avg(abs(target - p)), 6) AS mae, round(sqrt(avg((target - p) * (target - p))), 6)
  AS rmse, round(avg(greatest(0.8 * (target - p), (0.8 - 1) * (target - p))), 6) AS pinball
FROM long GROUP BY model"""
ORACLE["ridge_stack"] = KNN_CTES + """, s AS (
  SELECT count(*) AS n, avg(target) AS my, avg(knn_pred) AS m1, avg(family_mean) AS m2,
         covar_pop(knn_pred, knn_pred) * count(*) AS a, covar_pop(knn_pred, family_mean) * count(*) AS b,
         covar_pop(family_mean, family_mean) * count(*) AS c,
         covar_pop(knn_pred, target) * count(*) AS p, covar_pop(family_mean, target) * count(*) AS q
  FROM bf WHERE is_train),
beta AS (SELECT ((c + 1.0) * p - b * q) / ((a + 1.0) * (c + 1.0) - b * b) AS b1,
                ((a + 1.0) * q - b * p) / ((a + 1.0) * (c + 1.0) - b * b) AS b2, my, m1, m2 FROM s)
SELECT 'intercept' AS term, round(my - b1 * m1 - b2 * m2, 6) AS coef FROM beta
UNION ALL SELECT 'knn_pred', round(b1, 6) FROM beta
UNION ALL SELECT 'family_mean', round(b2, 6) FROM beta"""


# --- sequences and I/O --------------------------------------------------------
SEQ_STATIC = ["id_season", "num_sizes", "has_plus_sizes", "price", "life_cycle_length", "vec_id"]
ORACLE["week_position"] = with_panel(
    'SELECT "ID", year, num_week_iso, CAST(row_number() OVER (PARTITION BY "ID" ORDER BY year, num_week_iso) '
    'AS INTEGER) AS week_pos FROM panel')

ORACLE["week_sequence"] = with_panel(f""", s AS (
  SELECT "ID", {", ".join(first_sql(c) for c in SEQ_STATIC)}, CAST(count(*) AS INTEGER) AS seq_len,
         list({ORDER_KEY} ORDER BY year, num_week_iso) AS week_keys,
         list(CAST(weekly_sales AS DOUBLE) ORDER BY year, num_week_iso) AS weekly_sales_seq,
         list(CAST(weekly_demand AS DOUBLE) ORDER BY year, num_week_iso) AS weekly_demand_seq,
         {first_sql("Production", "target")}
  FROM panel GROUP BY "ID")
SELECT *, list_concat(weekly_sales_seq, list_transform(range((SELECT max(seq_len) FROM s) - seq_len),
                      lambda x: 0.0)) AS weekly_sales_padded,
          list_concat(weekly_demand_seq, list_transform(range((SELECT max(seq_len) FROM s) - seq_len),
                      lambda x: 0.0)) AS weekly_demand_padded
FROM s""")

ORACLE["csv_roundtrip"] = ORACLE["product_table"]
ORACLE["forecast_files"] = ORACLE["forecast_mean"]
ORACLE["spec_roundtrip"] = (
    products_ctes().rstrip("\n") + f", dict AS ({DICT_SQL})\n"
    "SELECT 'label_dictionary' AS spec, \"column\", value, code, CAST(NULL AS DATE) AS origin FROM dict\n"
    "UNION ALL SELECT 'date_origins', 'phase_in', NULL, NULL, (SELECT min(phase_in) FROM pt WHERE is_train)\n"
    "UNION ALL SELECT 'date_origins', 'phase_out', NULL, NULL, (SELECT min(phase_out) FROM pt WHERE is_train)")


# --- remaining scalar operators -------------------------------------------------
ORACLE["life_cycle_projection"] = (
    f"WITH panel AS ({PANEL_SQL}), ps AS ({PRODUCT_SEASON_SQL})\n"
    "SELECT \"ID\", season_year, date_diff('day', phase_in_first, phase_out_first) / 7.0 * weekly_demand_mean"
    " AS projected_demand FROM ps")
ORACLE["category_widths"] = (
    products_ctes().rstrip("\n") + f", dict AS ({DICT_SQL})\n"
    "SELECT \"column\", CAST(count(*) AS INTEGER) AS n_classes, "
    "CAST(least(50, floor(count(*) / 2) + 1) AS INTEGER) AS factor_width FROM dict GROUP BY \"column\"")


# --- profile report parts and the pseudo-target ridge -------------------------------
ORACLE["numeric_histogram"] = with_panel(""", mm AS (SELECT min(price) AS lo, max(price) AS hi FROM panel)
SELECT CAST(least(floor((price - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n
FROM panel, mm WHERE price IS NOT NULL GROUP BY 1""")

_PAIRS = ["weekly_sales", "weekly_demand", "price", "num_stores", "Production"]
ORACLE["correlations"] = with_panel("\nUNION ALL\n".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr(\"{a}\", \"{b}\"), 6) AS corr FROM panel"
    for i, a in enumerate(_PAIRS) for b in _PAIRS[i + 1:]))

ORACLE["ridge_pseudo"] = KNN_CTES + """, zs AS (
  SELECT avg(knn_pred) AS m1, stddev_pop(knn_pred) AS s1, avg(family_mean) AS m2, stddev_pop(family_mean) AS s2
  FROM bf),
z AS (SELECT (knn_pred - m1) / CASE WHEN s1 = 0 THEN 1.0 ELSE s1 END AS x1,
             (family_mean - m2) / CASE WHEN s2 = 0 THEN 1.0 ELSE s2 END AS x2,
             (knn_pred + family_mean) / 2 AS y FROM bf, zs),
s AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2,
             covar_pop(x1, x1) * count(*) AS a, covar_pop(x1, x2) * count(*) AS b, covar_pop(x2, x2) * count(*) AS c,
             covar_pop(x1, y) * count(*) AS p, covar_pop(x2, y) * count(*) AS q FROM z),
beta AS (SELECT ((c + 1.0) * p - b * q) / ((a + 1.0) * (c + 1.0) - b * b) AS b1,
                ((a + 1.0) * q - b * p) / ((a + 1.0) * (c + 1.0) - b * b) AS b2, my, m1, m2 FROM s)
SELECT 'intercept' AS term, round(my - b1 * m1 - b2 * m2, 6) AS coef FROM beta
UNION ALL SELECT 'knn_pred', round(b1, 6) FROM beta
UNION ALL SELECT 'family_mean', round(b2, 6) FROM beta"""


# --- text parsing, style flags, histories and the prepared test table ------------------
ORACLE["parse_dates"] = """
SELECT o_orderkey,
  CASE o_orderkey % 3 WHEN 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') WHEN 1 THEN strftime(CAST(o_orderdate AS DATE), '%-d/%-m/%Y')
       ELSE 'on ' || strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS written,
  CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day
FROM orders"""
ORACLE["parse_vectors"] = """
SELECT vec_id, CAST(len(embedding) + 1 AS INTEGER) AS n, TRUE AS last_is_null, CAST(len(embedding) AS INTEGER) AS n_same FROM embeddings"""
ORACLE["cosine_pairs"] = """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
ORACLE["style_flags"] = season_ctes() + """
SELECT "ID", season_year, CAST("ID" % 6 IN (0, 3) AS INTEGER) AS is_outerwear, CAST("ID" % 6 < 2 AS INTEGER) AS is_formal,
       CAST("ID" % 6 IN (2, 3) AS INTEGER) AS is_casual FROM ps"""
ORACLE["season_dataset"] = season_ctes() + """
SELECT "ID", season_year, "Production_max", sell_through_ratio, stores_per_size, is_outerwear, family_first, category_first FROM sf"""
ORACLE["early_stop"] = with_panel(""", h AS (
  SELECT year * 53 + num_week_iso AS round, round(sum(weekly_demand) / count(weekly_demand), 9) AS val_loss FROM panel GROUP BY 1),
b AS (SELECT round, arg_min(round, (val_loss, round)) OVER (ORDER BY round ROWS UNBOUNDED PRECEDING) AS best_round FROM h),
s AS (SELECT min(round) AS stop FROM b WHERE round - best_round >= 10)
SELECT arg_min(round, (val_loss, round)) AS best_round, min(val_loss) AS best_loss FROM h, s WHERE stop IS NULL OR round <= stop""")
_TEST_CATS = ["family", "category", "color_name"]
_TEST_DICT = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
    f"FROM (SELECT DISTINCT coalesce({c}, 'nan') AS v FROM pt0 WHERE is_train)" for c in _TEST_CATS)
ORACLE["prepared_test_table"] = (
    f"WITH panel AS ({PANEL_SQL}), pt0 AS ({PRODUCTS_SQL}), dict AS ({_TEST_DICT}),\n"
    "pt AS (SELECT * REPLACE (CASE WHEN \"ID\" % 5 = 0 THEN 'unheard of' ELSE color_name END AS color_name) FROM pt0)\n"
    "SELECT \"ID\", " + ", ".join(f"{_encoded(c, True)} AS {c}" for c in _TEST_CATS) + """,
  CAST(coalesce(date_diff('day', (SELECT min(phase_in) FROM pt WHERE is_train), phase_in), 0) AS DOUBLE) AS phase_in,
  CAST(coalesce(date_diff('day', (SELECT min(phase_out) FROM pt WHERE is_train), phase_out), 0) AS DOUBLE) AS phase_out,
  price, num_stores, CAST(has_plus_sizes AS INTEGER) AS has_plus_sizes,
  round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS image_sum
FROM pt JOIN embeddings USING (vec_id) WHERE NOT is_train AND id_season = 1""")

ORACLE["zscore_stored"] = ORACLE["zscore"]
