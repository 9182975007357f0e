"""Hand-made edge fixtures for the null/edge semantics N1-N15 and D1/D5/D6/W2."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seasoncast.functions.measures import clipped_ratio, uplift
from seasoncast.functions.parse import fill_category, parse_date, parse_rgb
from seasoncast.operators import aggregate as agg
from seasoncast.operators import clean, encode, sequence, similarity


def test_first_non_null_mixes_rows(spark):  # N1
    df = spark.createDataFrame([(1, 2020, 1, None, "p"), (1, 2020, 2, "x", "q")],
                               "ID long, year int, num_week_iso int, a string, b string")
    row = agg.product_first(df, columns=["a", "b"]).first()
    assert (row["a"], row["b"]) == ("x", "p")


def test_null_sum_and_null_key(spark):  # N2, N3
    df = spark.createDataFrame([(1, None), (1, None), (None, 5.0)], "ID long, weekly_demand double")
    rows = agg.season_target(df).collect()
    assert [(r["ID"], r["target_demand"]) for r in rows] == [(1, 0.0)]


def test_dates(spark):  # N4, N13, D1
    df = spark.createDataFrame([("03/02/2023",), ("2023-02-03",), ("2023-12-25",), ("x",), (None,)], "d string")
    parsed = [r[0] for r in df.select(parse_date("d")).collect()]
    assert parsed == [dt.date(2023, 2, 3), dt.date(2023, 2, 3), dt.date(2023, 12, 25), None, None]
    spec = encode.fit_date_origins(df, ["d"])
    offs = [r["d"] for r in encode.apply_date_origins(df, spec, ["d"]).collect()]
    assert offs == [0.0, 0.0, 325.0, 0.0, 0.0]


def test_categories_append_and_clamp(spark):  # N5, N10, N11, N12
    train = spark.createDataFrame([("b",), ("a",), ("Z",), (None,)], "c string")
    test = spark.createDataFrame([(1, "a"), (2, "q"), (3, None)], "k int, c string")
    spec = encode.fit_label_dictionary(train, ["c"])
    codes = {r["value"]: r["code"] for r in spec.collect()}
    assert codes == {"Z": 0, "a": 1, "b": 2, "nan": 3}
    app = {r["k"]: r["c"] for r in encode.apply_label_dictionary(test, spec, ["c"]).collect()}
    assert app == {1: 1, 2: 4, 3: 3}
    clamp = {r["k"]: r["c"] for r in encode.apply_label_dictionary(test, spec, ["c"], policy="clamp").collect()}
    assert clamp == {1: 1, 2: 3, 3: 3}


def test_label_dictionary_partition_invariant(spark):
    rows = [(f"v{i % 37:03d}", f"w{i % 11}") for i in range(500)]
    df = spark.createDataFrame(rows, "a string, b string")
    ref = sorted(encode.fit_label_dictionary(df, ["a", "b"]).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = sorted(encode.fit_label_dictionary(df, ["a", "b"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert ref == one
    assert sorted(r["code"] for r in ref if r["column"] == "a") == list(range(37))


def test_missing_token(spark):  # N6
    df = spark.createDataFrame([(None,), ("x",)], "c string")
    assert [r[0] for r in df.select(fill_category("c", "NA")).collect()] == ["NA", "x"]


def test_rgb(spark):  # N7
    df = spark.createDataFrame([("1,2,3",), (None,)], "c string")
    assert [tuple(r) for r in df.select(*parse_rgb("c")).collect()] == [(1, 2, 3), (0, 0, 0)]


def test_negatives_and_trim(spark):  # N8
    df = spark.createDataFrame([(-1496.0,), (None,), (0.0,), (5.0,)], "x double")
    kept = [r[0] for r in clean.non_negative(df, ["x"]).collect()]
    assert kept == [None, 0.0, 5.0]
    trimmed = [r[0] for r in clean.trim_upper(clean.non_negative(df, ["x"]), "x", 1.0).collect()]
    assert trimmed == [0.0, 5.0]


def test_ratios(spark):  # N9
    df = spark.createDataFrame([(5.0, 0.0), (0.0, 0.0), (9.0, 3.0), (1.0, 2.0), (-1.0, 4.0)], "n double, d double")
    assert [r[0] for r in df.select(clipped_ratio("n", "d")).collect()] == [2.0, None, 2.0, 0.5, 0.0]


def test_zero_variance_scale(spark):  # N14
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    spec = encode.fit_scaler(df, ["x"])
    assert [r[0] for r in encode.apply_scaler(df, spec, ["x"]).collect()] == [0.0, 0.0]


def test_negative_forecast_clip(spark):  # N15
    df = spark.createDataFrame([(-3.0,)], "p double")
    assert df.select(uplift("p", 1.0, 0.0)).first()[0] == 0.0
    assert df.select(uplift("p", 1.0, None)).first()[0] == -3.0


def test_new_year_order(spark):  # D5
    df = spark.createDataFrame([(1, 2024, 1, 5.0), (1, 2023, 52, 7.0)],
                               "ID long, year int, num_week_iso int, weekly_demand double")
    row = sequence.week_sequences(df, ["weekly_demand"], target=None).first()
    assert row["week_keys"] == [202352, 202401]
    assert row["weekly_demand_seq"] == [7.0, 5.0]


def test_season_order_as_ints(spark):  # W2
    df = spark.createDataFrame([(1, "2021_2", 1.0, 1.0), (1, "2021_10", 2.0, 2.0)],
                               "ID long, season_year string, Production_max double, weekly_demand_sum double")
    rows = {r["season_year"]: r["season_order_for_id"] for r in agg.season_history(df).collect()}
    assert rows == {"2021_2": 1, "2021_10": 2}


def test_knn_self_match(spark):  # D6
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, vec array<double>")
    with_self = similarity.knn_join(items, items, k=1, exclude_self=False).collect()
    without = similarity.knn_join(items, items, k=1, exclude_self=True).collect()
    assert {(r["query_id"], r["neighbor_id"]) for r in with_self} == {(1, 1), (2, 2), (3, 3)}
    assert {(r["query_id"], r["neighbor_id"]) for r in without} == {(1, 2), (2, 1), (3, 2)}


@pytest.mark.parametrize("block_rows", [1, 2, 1000])
def test_knn_blocking_invariant(spark, block_rows):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(40)]
    items = spark.createDataFrame(rows, "id long, vec array<double>")
    got = sorted(tuple(r) for r in similarity.knn_join(items, items, k=3, block_rows=block_rows).collect())
    v = np.array([r[1] for r in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    want = []
    for i in range(40):
        order = sorted(range(40), key=lambda j: (-s[i, j], j))[:3]
        want += [(i, j, r + 1, round(float(s[i, j]), 9)) for r, j in enumerate(order)]
    assert got == sorted(want)


def test_artefact_columns(spark):  # P2, P7
    from pyspark.sql import types as T
    df = spark.createDataFrame([(1, 2)], "`ID` long, `Unnamed: 28` long")
    assert clean.drop_prefixed(df).columns == ["ID"]
    schema = T.StructType([T.StructField("ID", T.LongType()), T.StructField("price", T.DoubleType())])
    out = clean.reindex_columns(df, schema)
    assert out.columns == ["ID", "price"] and out.first()["price"] is None


def test_knn_index_matches_join(spark):
    import numpy as np
    rng = np.random.default_rng(11)
    corpus = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(30)], "id long, vec array<double>")
    queries = spark.createDataFrame([(100 + i, rng.normal(size=5).tolist()) for i in range(7)],
                                    "id long, vec array<double>")
    idx = similarity.KnnIndex(k=4, block_rows=8).fit(corpus)
    a = sorted(tuple(r) for r in idx.kneighbors(queries).collect())
    b = sorted(tuple(r) for r in similarity.knn_join(queries, corpus, k=4, exclude_self=False).collect())
    assert a == b and len(a) == 28


def test_schema_helpers(spark):  # P1, P3, P4, P5, P8, P10, P11
    import pytest as _pt
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "ID long, family string, price double")
    assert clean.drop_if_present(df, ["family", "nope"]).columns == ["ID", "price"]
    assert clean.keep_existing(df, ["price", "nope", "ID"]).columns == ["price", "ID"]
    assert clean.select_by_type(df).columns == ["ID", "price"]
    with _pt.raises(ValueError):
        clean.require_columns(df, ["ID", "moment"])
    assert clean.column_difference(df, df.select("ID")) == ["family", "price"]
    assert clean.rename(df, {"price": "p"}).columns == ["ID", "family", "p"]
    assert clean.equals(df, "family", "b").count() == 1
    assert clean.check_vector_width(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>"),
                                    "v", 2).count() == 1


def test_salted_dictionary_join_matches_broadcast(spark):
    rows = [(i, "hot" if i % 3 else f"v{i % 17}") for i in range(600)]   # one value holds 2/3 of rows
    df = spark.createDataFrame(rows, "k long, c string")
    spec = encode.fit_label_dictionary(df, ["c"])
    a = sorted(tuple(r) for r in encode.apply_label_dictionary(df, spec, ["c"]).collect())
    b = sorted(tuple(r) for r in encode.apply_label_dictionary(df, spec, ["c"], broadcast_bytes=0, salt=8).collect())
    assert a == b and len(b) == 600
