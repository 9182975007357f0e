"""Delimited scan of a reference-style test file: artefact columns, reindexing, forecast files."""

from pyspark.sql import types as T

from seasoncast.operators import clean
from seasoncast.sources import io


def test_test_file_flow(spark, tmp_path):
    path = tmp_path / "test.csv"
    path.write_text("ID;family;price;image_embedding;Unnamed: 28\n"
                    '1;A;2.5;"0.1,0.2";\n'
                    '2;;3.0;"0.3,0.4";\n')
    df = io.read_delimited(spark, str(path), sep=";")
    df = clean.drop_prefixed(df)
    assert df.columns == ["ID", "family", "price", "image_embedding"]
    schema = T.StructType([T.StructField("ID", T.LongType()), T.StructField("price", T.DoubleType()),
                           T.StructField("num_stores", T.IntegerType())])
    out = clean.reindex_columns(df, schema).orderBy("ID").collect()
    assert [tuple(r) for r in out] == [(1, 2.5, None), (2, 3.0, None)]
    from seasoncast.functions.parse import parse_vector
    vecs = [r[0] for r in df.select(parse_vector("image_embedding")).orderBy("ID").collect()]
    assert vecs == [[0.1, 0.2], [0.3, 0.4]]


def test_forecast_reader_case_and_fallback(spark, tmp_path):
    good = tmp_path / "preds.csv"
    good.write_text("id,PRODUCTION\n1,10.5\n2,7\n")
    df = io.read_forecasts(spark, [str(tmp_path / "missing.csv"), str(good)])
    assert df.columns == ["ID", "Production"]
    assert sorted(tuple(r) for r in df.collect()) == [(1, 10.5), (2, 7.0)]
    bad = tmp_path / "bad.csv"
    bad.write_text("key,value\n1,2\n")
    import pytest
    with pytest.raises(ValueError):
        io.read_forecasts(spark, str(bad))
