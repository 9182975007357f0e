"""Profiling, key overlap and top-k reports.

Per-column statistics are computed in one aggregate pass over the table and
then turned into one row per column with ``unpivot``/``stack``; nothing is
looped per column on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasoncast.functions.parse import fill_category
from seasoncast.operators.aggregate import order_key
from seasoncast.operators.quantile import exact_quantiles, value_columns
from seasoncast.session import materialise

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

PROFILE_COLUMNS = 3  # columns profiled in one aggregate: the code of many more is too long to be compiled


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value (A4); partial aggregation handles a hot value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values, ties by value (O4) -> TakeOrderedAndProject."""
    return value_counts(df, col).orderBy(F.desc("count"), F.asc(col)).limit(n)


def head(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """First ``n`` rows under an explicit order (O2)."""
    return df.orderBy(*order).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Number of distinct non-null values per column, one row per column (A5).

    Exact: rows become narrow (column, value as text) pairs, grouped with a
    map-side combine.  ``approx=True`` uses HyperLogLog++ in one pass."""
    cols = list(cols or df.columns)
    if approx:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).unpivot([], cols, "column", "n_unique")
    pairs = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "_v")
    return (pairs.groupBy("column", "_v").agg(F.lit(1).alias("_one"))
            .groupBy("column").agg(F.count("_v").alias("n_unique")))


def _extremes_per_key(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """A row a key with ``(low, multi)`` of every column: its least value, and whether there is another one."""
    return df.groupBy(F.col(key).alias("_key")).agg(*[F.struct(F.min(c).alias("low"), (F.min(c) != F.max(c)).alias("multi")).alias(c) for c in cols])


def _constant(per_key: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = per_key.agg(*[(~F.bool_or(F.coalesce(F.col(f"`{c}`.multi"), F.lit(False)))
                          & F.bool_or(F.col(f"`{c}`.low").isNotNull())).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "is_constant_per_ID")


def constant_per_key(df: DataFrame, key: str = "ID", cols: Sequence[str] | None = None) -> DataFrame:
    """Is every column constant inside each key?

    "max over keys of the distinct count == 1" holds exactly when no key has
    two different non-null values (min != max) and some key has a value, so
    one min/max aggregate per key replaces per-column distinct counts
    (no row expansion, fully partial-aggregated)."""
    cols = list(cols or df.columns)
    return _constant(_extremes_per_key(df, key, cols), cols)


def column_profile(df: DataFrame, key: str = "ID", order: Sequence[str] = ("year", "num_week_iso")) -> DataFrame:
    """dtype, missing, unique, first non-null example and constant-per-key flag.

    One min/max aggregate per key is written first; it tells which columns are
    constant per key, and the distinct values of those are counted on it.  Only
    the other columns are counted on all rows.  The parts are joined on the
    column name (one row per column each); fused, the distinct rewrite would
    replicate the plain aggregates' buffers once per distinct column."""
    cols = df.columns
    ok = order_key(tuple(order) + (key,))  # total order: the first row of the table
    plain = df.agg(*[F.struct(
        F.lit(f.dataType.simpleString()).alias("dtype"),
        F.count_if(F.col(f.name).isNull()).alias("missing"),
        F.min_by(F.col(f.name).cast("string"), F.when(F.col(f.name).isNotNull(), ok)).alias("example"),
    ).alias(f.name) for f in df.schema.fields])
    long = plain.unpivot([], cols, "column", "s").select("column", "s.dtype", "s.missing", "s.example")
    per_key = materialise(_extremes_per_key(df, key, cols), "extremes")
    constant = _constant(per_key, cols)
    flags = constant.collect()  # a row a column
    fixed = [r["column"] for r in flags if r["is_constant_per_ID"]]
    others = [c for c in cols if c not in fixed]
    uniq = distinct_counts(per_key.select(*[F.col(f"`{c}`.low").alias(c) for c in fixed]), fixed) if fixed else None
    more = distinct_counts(df, others) if others else None
    uniq = uniq.unionAll(more) if uniq is not None and more is not None else uniq if more is None else more
    known = df.sparkSession.createDataFrame([tuple(r) for r in flags], constant.schema)
    return (long.join(uniq.withColumnRenamed("n_unique", "unique"), "column").join(F.broadcast(known), "column")
            .select("column", "dtype", "missing", "unique", "example", "is_constant_per_ID"))


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None,
                    quantiles: Sequence[float] = (0.25, 0.5, 0.75), digits: int = 6) -> DataFrame:
    """Describe-style profile of numeric columns, one row per column.

    count, missing, mean, population std, min, exact quantiles, max, zeros, negatives.
    The numeric columns are cached once (as doubles); the moments and the
    quantile passes all read that cache, so the input plan runs once.  Mean and
    std are rounded to ``digits`` decimals (their last bits depend on the
    summation order).  The result is one row per column.
    """
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and (cols is None or f.name in cols)]
    base = value_columns(df, cols)
    try:
        qv = exact_quantiles(base, [(c, q) for c in cols for q in quantiles], persisted=True)
        moments = lambda c: F.struct(
            F.count(c).alias("count"),
            F.count_if(F.col(c).isNull()).alias("missing"),
            F.round(F.avg(c), digits).alias("mean"),
            F.round(F.stddev_pop(c), digits).alias("std"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
            F.count_if(F.col(c) == 0).alias("zeros"),
            F.count_if(F.col(c) < 0).alias("negatives"),
        ).alias(c)
        stats = {}
        for at in range(0, len(cols), PROFILE_COLUMNS):
            some = cols[at:at + PROFILE_COLUMNS]
            stats.update(base.agg(*[moments(c) for c in some]).first().asDict())
    finally:
        base.unpersist()
    qnames = [f"q{int(round(q * 100)):02d}" for q in quantiles]
    rows = [(c, *stats[c], *qv[i * len(quantiles):(i + 1) * len(quantiles)]) for i, c in enumerate(cols)]
    schema = ("column string, count bigint, missing bigint, mean double, std double, min double, max double, "
              "zeros bigint, negatives bigint, " + ", ".join(f"{q} double" for q in qnames))
    return df.sparkSession.createDataFrame(rows, schema)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Fixed-width histogram over [min, max] (part of the A10 report).

    NaN counts as missing; infinities have no place on the axis and are left out."""
    x = F.col(col).cast("double")
    finite = df.select(F.when(F.abs(x) < float("inf"), x).alias("x")).where("x is not null")  # NaN is above infinity
    lo, hi = finite.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    return finite.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def correlations(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson correlation of every column pair, one aggregate (A10 report)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.round(F.corr(a, b), digits).alias(f"{a}|{b}") for a, b in pairs])
    return (wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
            .select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("left"),
                    F.split_part("pair", F.lit("|"), F.lit(2)).alias("right"), "corr"))


def average_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ranks of all values of all columns, ties sharing their mean rank: ``side, value, n, rank`` (side = column).

    Nulls and NaN have no rank."""
    value = lambda c: F.col(c).cast("double")
    pairs = df.select(*[F.when(~F.isnan(value(c)), value(c)).alias(c) for c in cols]).unpivot([], list(cols), "side", "value")
    return _weighted_ranks(pairs.where("value is not null").withColumn("n", F.lit(1).cast("long")))


def _weighted_ranks(values: DataFrame) -> DataFrame:
    """``side, value, n, rank`` of rows ``side, value, n`` that stand for n equal ones.

    Values are counted first, so one that fills most rows is one row; the counts
    are dealt by range, summed inside the ranges, and the ranges' totals give
    the offsets - no task sorts a whole side.
    """
    counts = values.groupBy("side", "value").agg(F.sum("n").alias("n"))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(counts.repartitionByRange(parts, "side", "value").withColumn("_pid", F.spark_partition_id()), "rank-ranges")
    inside = Window.partitionBy("_pid", "side").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("side").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_pid", "side").agg(F.sum("n").alias("_n"))
    offsets = totals.select("_pid", "side", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    below = F.col("_off") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return (ranged.join(F.broadcast(offsets), ["_pid", "side"])  # partitions x sides rows
            .select("side", "value", "n", (below + (F.col("n") + 1) / 2).alias("rank")))


def spearman(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Rank correlation of every column pair over the rows that have both: ``left, right, spearman`` (A10 report).

    Equal rows are counted first.  A column is ranked once for all partners that
    are known where it is, and once more for each partner that misses some of
    its rows; the ranks are joined to the rows, a join a ranking, and all pairs
    are summed in one aggregate.  A pair without variation has none (null).
    """
    cols = list(cols)
    value = lambda c: F.col(c).cast("double")
    names = [f"c{i}" for i in range(len(cols))]
    rows = df.select(*[F.when(~F.isnan(value(c)), value(c)).alias(x) for c, x in zip(cols, names)])
    rows = materialise(rows.groupBy(*names).agg(F.count("*").alias("n")), "value-rows")
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    both = lambda i, j: F.col(names[i]).isNotNull() & F.col(names[j]).isNotNull()
    turned = pairs + [(j, i) for i, j in pairs]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, spearman double")
    missed = rows.agg(*[F.coalesce(F.bool_or(F.col(names[i]).isNotNull() & F.col(names[j]).isNull()), F.lit(False)) for i, j in turned]).first()
    side = {(i, j): f"{i}|{j}" if m else f"{i}" for (i, j), m in zip(turned, missed)}
    sides = {s: F.when(both(i, j), F.col(names[i])) for (i, j), s in side.items()}  # a partner that misses no row changes nothing
    of = {s: i for (i, _), s in side.items()}
    values = (rows.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), v.alias("value"), "n") for s, v in sides.items()])).alias("v"))
              .select("v.*").where("value is not null"))
    totals = {r["side"]: r["n"] for r in values.groupBy("side").agg(F.sum("n").alias("n")).collect()}  # at most a row an ordered pair
    ranks = _weighted_ranks(values)
    for s, i in of.items():
        own = ranks.where(F.col("side") == s).select(F.col("value").alias("_v"), F.col("rank").alias(f"r{s}"))
        rows = rows.join(own, F.col(names[i]) == F.col("_v"), "left").drop("_v")
    # Ranks less their mean, (total + 1) / 2, which both sides of a pair share.
    off = lambda i, j: F.when(both(i, j), F.col(f"r{side[i, j]}") - (totals.get(side[i, j], 0) + 1) / 2)
    sums = rows.agg(*[F.sum(F.col("n") * x * y).alias(f"{name}{i}|{j}") for i, j in pairs
                      for name, x, y in (("xy", off(i, j), off(j, i)), ("xx", off(i, j), off(i, j)), ("yy", off(j, i), off(j, i)))])
    ratio = lambda xy, xx, yy: F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx * yy))
    out = sums.select(F.explode(F.array(*[
        F.struct(F.lit(cols[i]).alias("left"), F.lit(cols[j]).alias("right"), F.col(f"xx{i}|{j}").isNotNull().alias("any"),
                 F.round(ratio(*[F.col(f"{x}{i}|{j}") for x in ("xy", "xx", "yy")]), digits).alias("spearman")) for i, j in pairs])).alias("p"))
    return out.select("p.*").where("any").drop("any")


def cramers_v(df: DataFrame, cols: Sequence[str], digits: int = 6, missing_token: str = "NA") -> DataFrame:
    """Association of every pair of categories by its contingency table: ``left, right, rows, chi2, cramers_v`` (A10 report).

    Tables of all pairs are counted in one aggregate; a missing category is a
    category.  A column with one category has no association (null).
    """
    cols = list(cols)
    filled = df.select(*[fill_category(c, missing_token).alias(c) for c in cols])
    couples = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(cols) for b in cols[i + 1:]])
    cells = materialise(filled.select(F.explode(couples).alias("p")).select("p.*").groupBy("left", "right", "x", "y").agg(F.count("*").alias("n")), "contingency")
    pair = ["left", "right"]
    rows_ = cells.groupBy(*pair, "x").agg(F.sum("n").alias("nx"))
    columns = cells.groupBy(*pair, "y").agg(F.sum("n").alias("ny"))
    sizes = rows_.groupBy(*pair).agg(F.sum("nx").alias("rows"), F.count("*").alias("kx")).join(columns.groupBy(*pair).agg(F.count("*").alias("ky")), pair)
    share = (cells.join(rows_, [*pair, "x"]).join(columns, [*pair, "y"]).groupBy(*pair)
             .agg(F.sum(F.col("n") * F.col("n") / (F.col("nx").cast("double") * F.col("ny"))).alias("s")))
    chi2 = F.col("rows") * (F.col("s") - 1)
    least = F.least("kx", "ky") - 1
    v = F.when(least > 0, F.sqrt(F.greatest(chi2, F.lit(0.0)) / (F.col("rows") * least)))
    return sizes.join(share, pair).select(*pair, "rows", F.round(chi2, digits).alias("chi2"), F.round(v, digits).alias("cramers_v"))


def sketch_profile(df: DataFrame, by: Sequence[str], cols: Sequence[str], numeric: Sequence[str] = (), lg_k: int = 12, k: int = 400) -> DataFrame:
    """Mergeable profiles, a row a (part, column): ``by..., column, rows, missing, distinct_sketch, quantile_sketch``.

    Distinct values go into an HLL sketch of ``2**lg_k`` registers, the numbers
    of ``numeric`` columns into a KLL sketch of parameter ``k`` - both of bounded
    size whatever the part.  Store the rows; :func:`merge_profiles` answers for any
    set of parts without reading the data again.
    """
    by, numeric = list(by), set(numeric)
    aggs, rows = [F.count("*").alias("_rows")], []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count_if(F.col(c).isNull()).alias(f"_m{i}"), F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"_d{i}")]
        if c in numeric:
            aggs.append(F.kll_sketch_agg_double(F.when(~F.isnan(x), x), k).alias(f"_q{i}"))
        rows.append(F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"_m{i}").alias("missing"), F.col(f"_d{i}").alias("distinct_sketch"),
                             (F.col(f"_q{i}") if c in numeric else F.lit(None).cast("binary")).alias("quantile_sketch")))
    return df.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*rows)).alias("s")).select(*by, "s.*")


def merge_profiles(profiles: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75), k: int = 400) -> DataFrame:
    """Stored profiles of any parts as one: ``column, rows, missing, n_unique, q25, q50, q75``.

    ``n_unique`` is within about 3 x 1.04 / sqrt(2**lg_k) of the truth (5 % at 12),
    a quantile's rank within about 2 / k (0.5 % at 400).
    """
    merged = profiles.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"),
        F.hll_sketch_estimate(F.expr("hll_union_agg(distinct_sketch)")).alias("n_unique"),
        F.expr(f"kll_merge_agg_double(quantile_sketch, {k})").alias("_q"))
    empty = F.col("_q").isNull() | (F.kll_sketch_get_n_double("_q") == 0)
    values = [F.when(~empty, F.kll_sketch_get_quantile_double(F.when(~empty, F.col("_q")), F.lit(float(p)))).alias(f"q{int(round(p * 100)):02d}") for p in quantiles]
    return merged.select("column", "rows", "missing", "n_unique", *values)


def key_sides(left: DataFrame, right: DataFrame, key: str = "ID") -> DataFrame:
    """One row per distinct key with flags for the sides it occurs on.

    A union of the two key columns and one aggregate: duplicates (and a hot key)
    combine map-side, and there is a single shuffle on the key — no distinct +
    join or semi/anti-join pairs."""
    u = (left.select(key, F.lit(True).alias("_l"), F.lit(False).alias("_r"))
         .unionByName(right.select(key, F.lit(False).alias("_l"), F.lit(True).alias("_r"))))
    return u.where(F.col(key).isNotNull()).groupBy(key).agg(F.bool_or("_l").alias("_l"), F.bool_or("_r").alias("_r"))


def key_overlap(left: DataFrame, right: DataFrame, key: str = "ID") -> DataFrame:
    """Key counts: left, right, both, left only, right only."""
    l_, r_ = F.col("_l"), F.col("_r")
    return key_sides(left, right, key).agg(
        F.count_if(l_).alias("n_left"), F.count_if(r_).alias("n_right"),
        F.count_if(l_ & r_).alias("n_both"), F.count_if(l_ & ~r_).alias("n_left_only"),
        F.count_if(~l_ & r_).alias("n_right_only"))


def keys_intersect(left: DataFrame, right: DataFrame, key: str = "ID") -> DataFrame:
    """Keys present on both sides."""
    return key_sides(left, right, key).where(F.col("_l") & F.col("_r")).select(key)


def keys_except(left: DataFrame, right: DataFrame, key: str = "ID") -> DataFrame:
    """Keys on one side only, both directions, labelled by side."""
    sides = key_sides(left, right, key).where(F.col("_l") != F.col("_r"))
    return sides.select(key, F.when(F.col("_l"), F.lit("left_only")).otherwise(F.lit("right_only")).alias("side"))
