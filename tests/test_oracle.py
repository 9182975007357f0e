"""Every registered query with an oracle must match DuckDB exactly (small scale for speed)."""

import pytest

import __spark_entry__ as ent
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = ent.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, ent.queries()[name], ORACLES[name], SF, con)
    assert r["cols_match"], r
    assert not r["type_diff"], r["type_diff"]
    assert r["exact"], {k: v for k, v in r.items() if k.startswith("only_")}


def test_entry_smoke(spark):
    df = ent.entry(spark)
    assert df.count() > 0
    assert "target_demand" in df.columns
