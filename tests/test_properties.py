"""Hypothesis property tests: exact quantiles and ratio clipping against plain Python."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seasoncast.functions.measures import clipped_ratio
from seasoncast.operators.quantile import exact_quantiles

values = st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                  min_size=1, max_size=300)


@settings(max_examples=15, deadline=None)
@given(values, st.sampled_from([0.0, 0.1, 0.5, 0.8, 0.995, 1.0]))
def test_exact_quantile_matches_definition(spark, xs, q):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = exact_quantiles(df, [("v", q)], buckets=4, settle_rows=8)[0]
    s = sorted(xs)
    h = (len(s) - 1) * q
    lo, hi = s[math.floor(h)], s[math.ceil(h)]
    assert got == lo + (hi - lo) * (h - math.floor(h))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-3, 3)), min_size=1, max_size=40))
def test_clipped_ratio(spark, pairs):
    df = spark.createDataFrame([(float(n), float(d)) for n, d in pairs], "n double, d double")
    got = [r[0] for r in df.select(clipped_ratio("n", "d")).collect()]
    for (n, d), g in zip(pairs, got):
        if d == 0:
            assert g == (2.0 if n > 0 else 0.0 if n < 0 else None)
        else:
            assert g == min(max(n / d, 0.0), 2.0)


def test_numpy_interp_agrees(spark):
    rng = np.random.default_rng(5)
    xs = rng.lognormal(size=5000)
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    got = exact_quantiles(df, [("v", 0.25), ("v", 0.75)])
    assert np.allclose(got, np.quantile(xs, [0.25, 0.75]), rtol=0, atol=1e-12)
