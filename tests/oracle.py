"""Spark-vs-DuckDB comparison used by the tests and by ``python -m tests.oracle``.

Columns are sorted by name, rows are compared as an order-insensitive multiset.
``exact`` demands identical values (what a value hash sees); ``close`` allows a
relative float tolerance, to tell representation noise from real mismatches.
"""

from __future__ import annotations

import datetime as _dt
import math
import sys
import time
from collections import Counter

import duckdb

from seasoncast.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN", "float": "FLOAT", "array<double>": "DOUBLE[]",
                 "array<float>": "FLOAT[]", "array<int>": "INTEGER[]", "timestamp_ntz": "TIMESTAMP", "array<bigint>": "BIGINT[]",
                 "smallint": "SMALLINT", "tinyint": "TINYINT"}


def _norm(v, digits=None):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if digits is not None:
            return float(f"{v:.{digits}g}")
        return v
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), digits)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    return v


def _rows(cols, rows, digits=None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i], digits) for i in order) for r in rows)


def compare(spark, query, sql: str, sf_dir: str, con=None) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    scols = sdf.columns
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    res = {
        "spark_rows": len(srows), "duck_rows": len(drows),
        "cols_match": sorted(scols) == sorted(dcols),
        "spark_cols": scols, "duck_cols": dcols,
        "spark_types": [f.dataType.simpleString() for f in sdf.schema.fields],
        "duck_types": [str(t) for t in rel.types],
        "spark_sec": round(t1 - t0, 2),
    }
    sp = dict(zip(scols, res["spark_types"]))
    dk = dict(zip(dcols, res["duck_types"]))
    res["type_diff"] = {c: (sp[c], dk.get(c)) for c in scols
                        if c in dk and SPARK_TO_DUCK.get(sp[c], sp[c].upper()) != dk[c]}
    res["exact"] = res["cols_match"] and _rows(scols, srows) == _rows(dcols, drows)
    res["close"] = res["cols_match"] and _rows(scols, srows, 9) == _rows(dcols, drows, 9)
    if not res["close"] and res["cols_match"]:
        a, b = _rows(scols, srows, 9), _rows(dcols, drows, 9)
        res["only_spark"] = list((a - b).elements())[:3]
        res["only_duck"] = list((b - a).elements())[:3]
    return res


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as ent
    from seasoncast.session import get_session

    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")] or sorted(ent.queries())
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    oracle = ent.oracle_sql()
    qs = ent.queries()
    bad = 0
    for n in names:
        if n not in oracle:
            df = qs[n](spark, sf_dir)
            print(f"{n:28s} rows-only {df.count()} rows")
            continue
        try:
            r = compare(spark, qs[n], oracle[n], sf_dir, con)
        except Exception as e:  # report and continue
            print(f"{n:28s} ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ok = r["exact"]
        bad += not ok
        print(f"{n:28s} {'EXACT' if ok else ('close' if r['close'] else 'MISMATCH')} "
              f"rows {r['spark_rows']}/{r['duck_rows']} {r['spark_sec']}s"
              + (f" TYPES {r['type_diff']}" if r["type_diff"] else ""))
        if not ok:
            print("   ", {k: v for k, v in r.items() if k not in ("exact", "close")})
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
