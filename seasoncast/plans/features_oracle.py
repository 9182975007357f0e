"""DuckDB statements of the queries in ``features.py``."""

from __future__ import annotations

from seasoncast.plans.oracle import KNN_CTES, ORACLE, PANEL_COLUMNS, first_sql, products_ctes, with_panel

_TEXTS = ("aggregated_family", "family", "category", "color_name", "color_rgb")
_STAT_CATS = ("family", "category", "color_name")
_PT = products_ctes().rstrip("\n")
_DIGEST = "md5(concat(CAST(\"ID\" AS VARCHAR), ':42'))"

ORACLE["knn_index"] = KNN_CTES + "SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_neighbors, TRUE AS found_95 FROM topk"
ORACLE["knn_index_all"] = ORACLE["knn_topk"]
ORACLE["knn_total_demand"] = KNN_CTES + f""", f AS (
  SELECT "ID" AS id, {first_sql("life_cycle_length")}, {first_sql("weekly_demand")} FROM panel GROUP BY "ID")
SELECT query_id, round(sum(weight * (life_cycle_length * weekly_demand)), 6) AS total_demand
FROM wts JOIN f ON f.id = neighbor_id GROUP BY query_id"""

ORACLE["weighted_quantile"] = _PT + """, w AS (
  SELECT family, target_demand AS v,
         CAST(round(exp(-0.2 * greatest(date_diff('day', phase_out, DATE '2002-01-01') / 30.0, 0.0)) * 1000000) AS BIGINT) + 1 AS w
  FROM pt WHERE is_train),
c AS (SELECT *, sum(w) OVER (PARTITION BY family ORDER BY v) AS upto, sum(w) OVER (PARTITION BY family) AS total FROM w)
SELECT family, CAST(any_value(total) AS BIGINT) AS weight, min(v) FILTER (WHERE upto >= 0.65::DOUBLE * total) AS quantile FROM c GROUP BY family"""

_FRAME = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
ORACLE["ordered_stats"] = _PT + f""", tr AS (SELECT *, {_DIGEST} AS digest FROM pt WHERE is_train),
pr AS (SELECT sum(target_demand) / count(target_demand) AS p FROM tr)
SELECT "ID", """ + ", ".join(
    f"round((coalesce(sum(target_demand) OVER (PARTITION BY {c} ORDER BY digest {_FRAME}), 0.0) + p) "
    f"/ (count(*) OVER (PARTITION BY {c} ORDER BY digest {_FRAME}) + 1.0::DOUBLE), 6) AS {c}_ts" for c in _STAT_CATS) + " FROM tr, pr"
ORACLE["target_stats"] = _PT + """, pr AS (SELECT sum(target_demand) / count(target_demand) AS p FROM pt WHERE is_train)
SELECT "ID", """ + ", ".join(
    f"round((coalesce((SELECT sum(target_demand) FROM pt t WHERE is_train AND t.{c} = pt.{c}), 0.0) + p) "
    f"/ ((SELECT count(*) FROM pt t WHERE is_train AND t.{c} = pt.{c}) + 1.0::DOUBLE), 6) AS {c}_ts" for c in _STAT_CATS) + " FROM pt, pr WHERE NOT is_train"

_SEQ = f"""s AS (
  SELECT "ID", CAST(count(*) AS INTEGER) AS seq_len, list(CAST(weekly_sales AS DOUBLE) ORDER BY year, num_week_iso) AS weekly_sales_seq,
         list(CAST(weekly_demand AS DOUBLE) ORDER BY year, num_week_iso) AS weekly_demand_seq, {first_sql("Production", "target")}
  FROM panel GROUP BY "ID")"""
_PACKED = f""", {_SEQ},
r AS (SELECT *, row_number() OVER (ORDER BY seq_len, {_DIGEST}) - 1 AS r FROM s),
o AS (SELECT *, r // 64 AS batch, CAST(sum(seq_len) OVER (PARTITION BY r // 64 ORDER BY r) AS INTEGER) AS upto,
             max(seq_len) OVER (PARTITION BY r // 64) AS longest FROM r)"""
ORACLE["packed_batches"] = with_panel(_PACKED + """
SELECT batch, CAST(count(*) AS INTEGER) AS n_rows, max(seq_len) AS max_len, list("ID" ORDER BY r) AS ids, list(target ORDER BY r) AS targets,
       list_prepend(0, list(upto ORDER BY r)) AS offsets, flatten(list(weekly_sales_seq ORDER BY r)) AS weekly_sales_values,
       flatten(list(weekly_demand_seq ORDER BY r)) AS weekly_demand_values
FROM o GROUP BY batch""")
ORACLE["padded_batches"] = with_panel(_PACKED + """
SELECT batch, flatten(list(list_concat(weekly_demand_seq, list_transform(range(longest - seq_len), lambda x: 0.0::DOUBLE)) ORDER BY r)) AS weekly_demand_padded,
       CAST(sum(longest - seq_len) AS INTEGER) AS n_padding
FROM o GROUP BY batch""")

ORACLE["weekly_vectors"] = with_panel(f""", f AS (
  SELECT "ID", {", ".join(first_sql(c) for c in ("num_sizes", "price", "life_cycle_length", "vec_id"))}, {first_sql("Production", "target")} FROM panel GROUP BY "ID")
SELECT p."ID", CAST(row_number() OVER (PARTITION BY p."ID" ORDER BY year, num_week_iso) AS INTEGER) AS week_pos, year * 100 + num_week_iso AS week_key, target,
       CAST(5 + len(embedding) AS INTEGER) AS n_values,
       [weekly_sales, weekly_demand, CAST(f.num_sizes AS DOUBLE), f.price, CAST(f.life_cycle_length AS DOUBLE)] AS figures,
       round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS vector_sum
FROM panel p JOIN f USING ("ID") JOIN embeddings e ON e.vec_id = f.vec_id""")

_TRAIN = "substr(md5(concat(CAST(\"ID\" AS VARCHAR), ':42')), 1, 8) < 'cccccccc'"
ORACLE["sequence_moments"] = with_panel(f""", f AS (
  SELECT "ID", count(*) AS weeks, {first_sql("price")}, {first_sql("vec_id")} FROM panel WHERE {_TRAIN} GROUP BY "ID"),
v AS (SELECT "ID", weeks, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM f JOIN embeddings USING (vec_id)),
m AS (SELECT i, sum(weeks * x) / sum(weeks) AS mean FROM v GROUP BY i)
SELECT 'weekly_sales_seq' AS "column", round(avg(weekly_sales), 6) AS mean, round(stddev_pop(weekly_sales), 6) AS std FROM panel WHERE {_TRAIN}
UNION ALL SELECT 'weekly_demand_seq', round(avg(weekly_demand), 6), round(stddev_pop(weekly_demand), 6) FROM panel WHERE {_TRAIN}
UNION ALL SELECT 'price', round(avg(f.price), 6), round(stddev_pop(f.price), 6) FROM panel p JOIN f USING ("ID")
UNION ALL SELECT 'embedding[' || i || ']', round(any_value(mean), 6), round(sqrt(sum(weeks * (x - mean) * (x - mean)) / sum(weeks)), 6) FROM v JOIN m USING (i) GROUP BY i""")
ORACLE["sequence_scaled"] = with_panel(f""", {_SEQ},
m AS (SELECT avg(weekly_sales) AS m1, stddev_pop(weekly_sales) AS s1, avg(weekly_demand) AS m2, stddev_pop(weekly_demand) AS s2 FROM panel WHERE {_TRAIN})
SELECT "ID", list_transform(weekly_sales_seq, lambda x: round((x - m1) / s1, 6)) AS weekly_sales_seq,
       list_transform(weekly_demand_seq, lambda x: round((x - m2) / s2, 6)) AS weekly_demand_seq FROM s, m""")
ORACLE["sequence_restored"] = with_panel(f""", {_SEQ} SELECT "ID", round(target, 6) AS target, weekly_sales_seq, weekly_demand_seq FROM s""")
ORACLE["zscore_inverse"] = products_ctes() + 'SELECT "ID", ' + ", ".join(
    f"round(CAST({c} AS DOUBLE), 9) AS {c}" for c in ("price", "num_stores", "num_sizes", "life_cycle_length", "target_demand")) + " FROM pt"


def _ranked(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE)"


_RANKED = ("weekly_sales", "weekly_demand", "price", "num_stores")
ORACLE["spearman"] = with_panel(", r AS (SELECT " + ", ".join(f"{_ranked(c)} AS {c}" for c in _RANKED) + " FROM panel)\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS spearman FROM r" for i, a in enumerate(_RANKED) for b in _RANKED[i + 1:]))
ORACLE["average_ranks"] = with_panel("\nUNION ALL\n".join(
    f"SELECT '{c}' AS side, CAST({c} AS DOUBLE) AS value, count(*) AS n, any_value(r) AS rank FROM (SELECT {c}, {_ranked(c)} AS r FROM panel) GROUP BY {c}"
    for c in ("weekly_demand", "num_stores")))

_CATS = ("aggregated_family", *_STAT_CATS)


def _association(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS "left", '{b}' AS "right", CAST(n AS BIGINT) AS rows, round(n * (s - 1), 6) AS chi2,
       CASE WHEN least(ka, kb) > 1 THEN round(sqrt(greatest(n * (s - 1), 0.0) / (n * (least(ka, kb) - 1))), 6) END AS cramers_v
FROM (SELECT sum(c) AS n, sum(c * c / (CAST(ca AS DOUBLE) * cb)) AS s, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb
      FROM (SELECT *, sum(c) OVER (PARTITION BY a) AS ca, sum(c) OVER (PARTITION BY b) AS cb
            FROM (SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS c FROM panel GROUP BY 1, 2)))"""


ORACLE["cramers_v"] = with_panel("\nUNION ALL\n".join(_association(a, b) for i, a in enumerate(_CATS) for b in _CATS[i + 1:]))
ORACLE["sketch_profile"] = with_panel("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count(\"{c}\") AS missing, TRUE AS unique_near, TRUE AS median_near FROM panel WHERE year >= 2000"
    for c in ("ID", "family", "price", "weekly_demand")))

ORACLE["csv_quoted"] = r"""
SELECT p_partkey AS "ID", ' "' || p_brand || '", size; ' || p_size || chr(10) || p_name || ' ""  ' AS note,
       [CAST(p_size AS DOUBLE), -0.5, CAST(p_partkey % 10 AS DOUBLE)] AS vector FROM part"""
ORACLE["forecast_bucketed"] = ORACLE["forecast_mean"]
ORACLE["typed_columns"] = with_panel("SELECT " + ", ".join(f'"{c}"' for c in PANEL_COLUMNS if c not in _TEXTS) + " FROM panel")
ORACLE["reindexed_columns"] = products_ctes() + """
SELECT CAST(num_stores AS BIGINT) AS num_stores, CAST(NULL AS VARCHAR) AS fabric, "ID", CAST(NULL AS DOUBLE) AS waist, price FROM pt"""
ORACLE["category_union"] = products_ctes() + """
SELECT "ID", family, CASE WHEN is_train THEN category ELSE 'NA' END AS category, color_name, CAST(id_season AS VARCHAR) AS id_season,
       CASE WHEN is_train THEN 'NA' ELSE color_rgb END AS color_rgb FROM pt"""
ORACLE["assembled_features"] = products_ctes() + """
SELECT "ID", list_concat(CAST(embedding AS DOUBLE[]), [price, CAST(num_stores AS DOUBLE), CAST(num_sizes AS DOUBLE), CAST(life_cycle_length AS DOUBLE)]) AS features
FROM pt JOIN embeddings USING (vec_id)"""

ORACLE["pca_rotation"] = """
WITH v AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
m AS (SELECT i, avg(x) AS mean FROM v GROUP BY i)
SELECT vec_id, round(sum((x - mean) * (x - mean)), 6) AS squared FROM v JOIN m USING (i) GROUP BY vec_id"""
ORACLE["booster_scores"] = products_ctes() + """
SELECT "ID", round(800.0::DOUBLE + 0.1::DOUBLE * CASE WHEN price <= 2000 THEN CASE WHEN life_cycle_length <= 150 THEN 12.5 ELSE -3.25 END ELSE 40.0 END
                 + 0.1::DOUBLE * CASE WHEN num_sizes <= 3 THEN 8.0 WHEN num_stores <= 1 THEN -6.0 ELSE 2.0 END, 6) AS "Production" FROM pt"""
ORACLE["stack_invariants"] = products_ctes() + "SELECT count(*) AS n, 0.0::DOUBLE AS bias, TRUE AS no_worse FROM pt WHERE NOT is_train"
