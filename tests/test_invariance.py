"""Results must not depend on the number of shuffle partitions."""

import pytest

import __spark_entry__ as ent
from tests.oracle import _rows

SF = "/root/testdata/sf0.001"
NAMES = ["product_table", "product_season", "season_history", "clean_panel", "label_dictionary",
         "knn_topk", "numeric_profile", "week_sequence"]


@pytest.mark.parametrize("name", NAMES)
def test_partition_invariant(spark, name):
    q = ent.queries()[name]
    results = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            df = q(spark, SF)
            results.append(_rows(df.columns, [tuple(r) for r in df.collect()]))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_early_stop_on_given_history(spark):
    from seasoncast.operators.blend import early_stop
    hist = spark.createDataFrame([(1, 5.0), (2, 4.0), (3, 4.5), (4, 3.0), (5, 3.5), (6, 3.6), (7, 2.0)],
                                 "round int, val_loss double")
    row = early_stop(hist, patience=2).first()
    assert (row["best_round"], row["best_loss"]) == (4, 3.0)      # stops at round 6, never sees round 7
    row = early_stop(hist, patience=5).first()
    assert (row["best_round"], row["best_loss"]) == (7, 2.0)
