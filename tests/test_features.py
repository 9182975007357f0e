"""Ordered statistics, packed and factored sequences, moments, ranks, associations, sketches and files on small odd tables."""

import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as ent
from seasoncast.operators import blend, encode, prefix, profile, sequence
from seasoncast.plans import queries as q
from seasoncast.sources import io

SF = "/root/testdata/sf0.001"


def test_ordered_stats_never_see_their_own_label(spark, monkeypatch):
    monkeypatch.setattr(prefix, "LEAF", 8)
    monkeypatch.setattr(encode, "leaf_bits", lambda n: prefix.leaf_bits(n, 8))
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "b", None]), float(rng.randrange(50))) for i in range(300)]
    rows += [(7, "hot", 99.0), (None, "a", 4.0), (1000, "new", None), (1001, "new", 3.0)]
    df = spark.createDataFrame(rows, "ID long, c string, y double")
    got = encode.ordered_target_stats(df, ["c"], "y").select("ID", "c", "y", "c_ts").collect()
    assert len(got) == len(rows)
    import hashlib
    digest = lambda i: hashlib.md5(f"{'' if i is None else i}:42".encode()).hexdigest()
    known = [r[2] for r in rows if r[2] is not None]
    prior = sum(known) / len(known)
    seen, want = {}, []
    for i, c, y in sorted(rows, key=lambda r: (digest(r[0]), r[2] is not None, r[2] or 0)):
        total, n = seen.get(c, (0.0, 0))
        want.append((i, c, y, round((total + prior) / (n + 1), 9)))
        seen[c] = (total + (y or 0.0), n + (y is not None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.ID, r.c, r.y, round(r.c_ts, 9)) for r in got), key=key) == sorted(want, key=key)
    spec = encode.target_stats_spec(df, ["c"], "y")
    test = spark.createDataFrame([(1, "hot"), (2, None), (3, "unheard")], "ID long, c string")
    for limit in (encode.BROADCAST_BYTES, 0):
        out = {r.ID: r.c_ts for r in encode.apply_target_stats(test, spec, ["c"], broadcast_bytes=limit).collect()}
        hot = [y for _, c, y in rows if c == "hot"]
        assert math.isclose(out[1], (sum(hot) + prior) / (len(hot) + 1)) and math.isclose(out[3], prior)
    assert encode.ordered_target_stats(df.where("ID < 0"), ["c"], "y").count() == 0


def panel_of(spark, weeks):
    rows = [(i, 2000 + w // 52, w % 52 + 1, float(w + i), 10.0 * i, i % 2) for i, n in weeks.items() for w in range(n)]
    return spark.createDataFrame(rows, "ID long, year int, num_week_iso int, weekly_demand double, Production double, vec_id long")


def test_batches_hold_every_value_once(spark):
    weeks = {i: 1 + i * 7 % 5 for i in range(23)} | {99: 140}
    seqs = sequence.week_sequences(panel_of(spark, weeks), ["weekly_demand"], pad=False)
    batches = sequence.pad_batches(sequence.packed_batches(seqs, ["weekly_demand"], batch_rows=5), ["weekly_demand"], pad_value=-1.0).collect()
    assert sorted(b.n_rows for b in batches) == [4, 5, 5, 5, 5]
    seen = {}
    for b in batches:
        assert b.offsets[0] == 0 and b.offsets[-1] == len(b.weekly_demand_values) and len(b.weekly_demand_padded) == b.n_rows * b.max_len
        for j, i in enumerate(b.ids):
            seen[i] = b.weekly_demand_values[b.offsets[j]:b.offsets[j + 1]]
            line = b.weekly_demand_padded[j * b.max_len:(j + 1) * b.max_len]
            assert line == seen[i] + [-1.0] * (b.max_len - len(seen[i])) and b.targets[j] == 10.0 * i
    assert seen == {i: [float(w + i) for w in range(n)] for i, n in weeks.items()}
    # one long product widens its own batch only
    assert sum(len(b.weekly_demand_padded) for b in batches) < 140 * 5 + 23 * 6
    assert sequence.packed_batches(seqs.where("ID < 0"), ["weekly_demand"]).count() == 0


def test_factored_rows_equal_the_repeated_ones(spark):
    panel = panel_of(spark, {1: 3, 2: 1, 3: 2})
    vectors = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    weekly, blocks = sequence.factored_rows(panel, ["weekly_demand"], ["Production"], vectors)
    assert blocks.count() == 3 and "block" not in weekly.columns
    got = {(r.ID, r.week_pos): r["values"] for r in sequence.expand_rows(weekly, blocks, ["weekly_demand"]).collect()}
    assert got == {(i, w + 1): [float(w + i), 10.0 * i] + ([1.0, 2.0] if i % 2 == 0 else []) for i, n in {1: 3, 2: 1, 3: 2}.items() for w in range(n)}


def test_moments_of_parts_merge_and_equal_the_expanded_rows(spark):
    rows = [(1, [1.0, 2.0, None], 3, 5.0, [1e6, 0.0]), (2, [4.0], 1, None, [1e6 + 1, 3.0]), (3, [], 0, 7.0, None), (4, [math.nan, 9.0], 2, 8.0, [1e6 + 2, None])]
    df = spark.createDataFrame(rows, "ID long, s array<double>, seq_len int, p double, v array<double>")
    flat = {"s": [1.0, 2.0, 4.0, 9.0], "p": [5.0] * 3 + [8.0] * 2, "v[0]": [1e6] * 3 + [1e6 + 1] + [1e6 + 2] * 2, "v[1]": [0.0] * 3 + [3.0]}
    whole = encode.sequence_moments(df, ["s"], ["p"], ["v"])
    parts = encode.merge_moments(encode.sequence_moments(df.where("ID < 3"), ["s"], ["p"], ["v"]).unionByName(encode.sequence_moments(df.where("ID >= 3"), ["s"], ["p"], ["v"])))
    for table in (whole, parts):
        got = {r["column"]: r for r in encode.moments_spec(table).collect()}
        assert set(got) == set(flat)
        for c, values in flat.items():
            assert math.isclose(got[c]["mean"], statistics.fmean(values)) and math.isclose(got[c]["std"], statistics.pstdev(values), rel_tol=1e-9)
    spec = encode.moments_spec(whole)
    back = encode.scale_sequences(encode.scale_sequences(df, spec, ["s"]), spec, ["s"], inverse=True, digits=9).orderBy("ID").collect()
    assert back[0]["s"] == [1.0, 2.0, None] and back[2]["s"] == []
    flat_spec = spark.createDataFrame([("s", 2.0, 0.0)], "column string, mean double, std double")
    assert encode.scale_sequences(df, flat_spec, ["s"]).orderBy("ID").first()["s"] == [-1.0, 0.0, None]


def test_rank_correlation_and_association(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1.0, 1.0, 2.0, rng.random()]), rng.choice([None, math.nan, 3.0, rng.random()]), 4.0, rng.choice(["a", "b", None]), rng.choice(["x", "y"]), "k") for _ in range(400)]
    df = spark.createDataFrame(rows, "p double, q double, flat double, a string, b string, one string").repartition(5)
    pdf = pd.DataFrame([r[:3] for r in rows], columns=["p", "q", "flat"])
    got = {(r.left, r.right): r.spearman for r in profile.spearman(df, ["p", "q", "flat"]).collect()}
    both = pdf[["p", "q"]].dropna().rank()
    assert math.isclose(got["p", "q"], both["p"].corr(both["q"]), abs_tol=1e-6)
    assert got["p", "flat"] is None and got["q", "flat"] is None
    v = {(r.left, r.right): r for r in profile.cramers_v(df, ["a", "b", "one"]).collect()}
    table = pd.crosstab(pd.Series([r[3] or "NA" for r in rows]), pd.Series([r[4] for r in rows])).to_numpy()
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    chi2 = ((table - expected) ** 2 / expected).sum()
    assert math.isclose(v["a", "b"].chi2, chi2, abs_tol=1e-5) and math.isclose(v["a", "b"].cramers_v, math.sqrt(chi2 / 400), abs_tol=1e-5)
    assert v["a", "one"].cramers_v is None
    assert profile.spearman(df.where("p < 0"), ["p", "q"]).count() == 0 and profile.cramers_v(df.where("p < 0"), ["a", "b"]).count() == 0


def test_rank_correlation_ranks_a_column_once(spark, monkeypatch):
    """Columns without gaps are ranked once, not once a partner; a partner with gaps has a ranking of its own."""
    rng = random.Random(6)
    rows = [(rng.choice([1.0, 2.0, rng.random()]), rng.choice([3.0, rng.random()]), rng.choice([-0.0, 0.0, rng.random()]), rng.choice([None, math.nan, 3.0, rng.random()])) for _ in range(300)]
    df = spark.createDataFrame(rows, "n double, q double, r1 double, `c0` double").repartition(3)
    ranked, weighted = [], profile._weighted_ranks

    def counted(values):
        ranked.append(values.select("side").distinct().count())
        return weighted(values)

    monkeypatch.setattr(profile, "_weighted_ranks", counted)
    pdf = pd.DataFrame(rows, columns=["n", "q", "r1", "c0"])
    for cols, sides in ((["n", "q", "r1"], 3), (["n", "q", "r1", "c0"], 7)):
        got = {(r.left, r.right): r.spearman for r in profile.spearman(df, cols).collect()}
        assert len(got) == len(cols) * (len(cols) - 1) // 2
        for (a, b), x in got.items():
            both = pdf[[a, b]].dropna().rank()
            assert math.isclose(x, both[a].corr(both[b]), abs_tol=2e-6)
        assert ranked.pop() == sides and not ranked


def test_merged_sketches_answer_for_the_union(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("part"), (F.col("id") * 37 % 50_021).cast("double").alias("x"),
                                    F.when(F.col("id") % 5 > 0, (F.col("id") % 11).cast("string")).alias("c"))
    parts = profile.sketch_profile(df, ["part"], ["x", "c"], ["x"])
    for chosen in ([0, 1, 2, 3, 4, 5, 6], [2, 5]):
        rows = df.where(F.col("part").isin(chosen))
        got = {r["column"]: r for r in profile.merge_profiles(parts.where(F.col("part").isin(chosen))).collect()}
        union = {r["column"]: r for r in profile.merge_profiles(profile.sketch_profile(rows.withColumn("part", F.lit(0)), ["part"], ["x", "c"], ["x"])).collect()}
        assert got["c"].n_unique == union["c"].n_unique == 11 and got["c"].q50 is None
        assert got["c"].missing == rows.where("c is null").count() and got["x"]["rows"] == rows.count()
        assert got["x"].n_unique == union["x"].n_unique  # registers of the union are the greatest of the parts'
        truth = rows.select("x").distinct().count()
        assert abs(got["x"].n_unique - truth) <= 0.05 * truth
        for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            assert abs(rows.where(F.col("x") <= got["x"][name]).count() / rows.count() - p) < 0.01


def test_files_of_other_tools(spark, tmp_path):
    frame = pd.DataFrame({"ID": [1, 2, 3], "note": ['a "b" c', "two\nlines, and more", None], "vec": ["1.0,2.0", "3.0,-4.5", "5,6"], "price": [1.5, None, 2.0]})
    frame.to_csv(tmp_path / "made.csv", index=False)
    got = io.read_delimited(spark, str(tmp_path / "made.csv"), "ID bigint, note string, vec string, price double", sep=",").orderBy("ID").collect()
    assert [tuple(r) for r in got] == [(1, 'a "b" c', "1.0,2.0", 1.5), (2, "two\nlines, and more", "3.0,-4.5", None), (3, None, "5,6", 2.0)]
    back = io.write_delimited(spark.createDataFrame(got), str(tmp_path / "again"), sep=";")
    again = pd.concat([pd.read_csv(p, sep=";") for p in sorted((tmp_path / "again").glob("*.csv"))]).sort_values("ID").reset_index(drop=True)
    assert again.equals(frame.assign(ID=again["ID"]))
    assert back.endswith("again")
    (tmp_path / "bad.csv").write_text("ID,price\n1,2.5\nx,3.0\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        io.read_delimited(spark, str(tmp_path / "bad.csv"), "ID bigint, price double", sep=",").collect()
    assert len(io.read_delimited(spark, str(tmp_path / "bad.csv"), "ID bigint, price double", sep=",", malformed="DROPMALFORMED").collect()) == 1


def test_histogram_leaves_out_what_has_no_place(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 10.0, math.nan, math.inf, -math.inf)] + [(None,)], "x double")
    assert {r.bin: r.n for r in profile.histogram(df, "x", 5).collect()} == {0: 2, 1: 1, 4: 1}
    assert profile.histogram(df.where("isnan(x)"), "x").count() == 0


def test_empty_dictionary_gives_class_zero(spark):
    empty = spark.createDataFrame([], "column string, value string, code int")
    df = spark.createDataFrame([(1, "a"), (2, None)], "ID long, c string")
    assert {r.c for r in encode.apply_label_dictionary(df, empty, ["c"], policy="clamp").collect()} == {0}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clean_panel_scans_the_lines_once(spark):
    df = ent.queries()["clean_panel"](spark, SF)
    assert "l_quantity" not in plan(df)  # the rows were written once, by the step that needs them twice


def test_bucketed_forecasts_join_without_an_exchange(spark):
    ids = spark.range(500).select(F.col("id").alias("ID"), F.col("id").cast("double").alias("Production"))
    tables = {n: io.read_bucketed(spark, io.write_bucketed(ids, io.scratch_path(spark, n), buckets=4)) for n in ("a", "b", "c")}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = blend.join_forecasts(tables)
        text = plan(wide)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert wide.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scored_file_covers_the_test_products(spark):
    got = ent.queries()["train_store_score"](spark, SF).collect()
    held = {r.ID for r in q.products(spark, SF).where("not is_train").collect()}
    assert {r.ID for r in got} == held and all(r.Production >= 0 and np.isfinite(r.Production) for r in got)
