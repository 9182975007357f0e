"""Running sums in leaves and parents equal plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from seasoncast.operators.prefix import leaf_bits, leaf_of, prefix_sums


@pytest.mark.parametrize("bits", [0, 1, 3, 6])
def test_prefix_sums(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), rng.randrange(2 ** bits), i, rng.randrange(10), rng.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, leaf long, i long, x long, f boolean").withColumn("one", F.lit(1))
    got = {r["i"]: (r["before_x"], r["before_one"]) for r in prefix_sums(df, ["k"], "leaf", ["i"], ["x", "one"], bits, digit=2).collect()}
    for k, a, i, _, _ in rows:
        first = [r for r in rows if r[0] == k and (r[1], r[2]) < (a, i)]
        assert got[i] == (sum(r[3] for r in first), len(first))


def test_leaves_follow_the_digest(spark):
    assert [leaf_bits(n) for n in (0, 1, 4096, 4097, 4096 * 5000)] == [0, 0, 0, 1, 13]
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("d"))
    got = [r["leaf"] for r in df.select("d", leaf_of("d", 5).alias("leaf")).orderBy("d").collect()]
    assert got == sorted(got) and set(got) == set(range(32))
    assert {r["leaf"] for r in df.select(leaf_of("d", 0).alias("leaf")).collect()} == {0}
