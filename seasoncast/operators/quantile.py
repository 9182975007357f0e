"""Exact quantiles by distributed selection.

Spark's exact ``percentile`` buffers every value of a group in one task, and
``percentile_approx`` is not exact.  Here each pass is one aggregation job
that builds equal-width histograms (``buckets`` cells, partial + final
aggregation) over the value range still known to hold the wanted rank; only
the histogram (at most ``buckets`` rows per target) reaches the driver.
The range shrinks about ``buckets``-fold per pass, so doubles resolve in a
handful of passes; a range whose remaining row count is small is settled by
collecting just those rows.  A value that holds a third of all rows is a
single-valued bucket and resolves at once.

Interpolation matches the usual continuous definition (``quantile_cont``):
``h = (n - 1) q``, ``v = x[floor h] + (x[ceil h] - x[floor h]) (h - floor h)``.

NaN counts as missing.  Infinities are values below and above all others; they
are counted, and the histograms range over the finite values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.session import materialise


def exact_quantiles(df: DataFrame, targets: Sequence[tuple[str, float]], buckets: int = 4096,
                    settle_rows: int = 8192, persisted: bool = False) -> list[float | None]:
    """Exact continuous quantiles for ``(column, q)`` pairs, batched per pass.

    ``persisted=True`` means ``df`` already holds just the (double) value
    columns in a cache, as ``value_columns`` returns."""
    cols = sorted({c for c, _ in targets})
    if persisted:
        return _quantiles(df, cols, targets, buckets, settle_rows)
    base = value_columns(df, cols)
    try:
        return _quantiles(base, cols, targets, buckets, settle_rows)
    finally:
        base.unpersist()


def value_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Only the value columns, as doubles, kept across passes (spilling to disk if
    needed), so the upstream plan runs once instead of once per pass."""
    value = lambda c: F.col(c).cast("double")
    return (df.select(*[F.when(~F.isnan(value(c)), value(c)).alias(c) for c in cols])
            .persist(StorageLevel.MEMORY_AND_DISK))


def _quantiles(base, cols, targets, buckets, settle_rows):
    finite = lambda c: F.when(F.abs(c) < math.inf, F.col(c))
    stats = base.agg(*[e for c in cols for e in (F.count(c), F.count_if(F.col(c) == -math.inf), F.count(finite(c)),
                                                 F.min(finite(c)), F.max(finite(c)))]).first()
    info = {c: stats[5 * i:5 * i + 5] for i, c in enumerate(cols)}

    # state per (column, rank): [lo, hi, below, count_in_range, value, rank]
    state: dict[tuple[str, int], list] = {}
    plan = []
    for c, q in targets:
        n, low, inner, lo, hi = info[c]
        if not n:
            plan.append(None)
            continue
        h = (n - 1) * q
        k1, k2 = math.floor(h), math.ceil(h)
        for k in (k1, k2):
            known = -math.inf if k < low else math.inf if k >= low + inner else lo if lo == hi else None
            state.setdefault((c, k), [lo, hi, low, inner, known, k])
        plan.append((c, k1, k2, h - k1))

    while True:
        open_ = {key: s for key, s in state.items() if s[4] is None}
        if not open_:
            break
        members: dict[tuple, list[list]] = {}
        for (c, k), s in open_.items():
            members.setdefault((c, s[0], s[1], s[3]), []).append(s)
        ranges = sorted(members)
        before = [tuple(s[:4]) for s in open_.values()]
        small = [(r, members[r]) for r in ranges if r[3] <= settle_rows]
        large = [(r, members[r]) for r in ranges if r[3] > settle_rows]
        if small:
            _settle(base, small)
        if large:
            _narrow(base, large, buckets)
        if before == [tuple(s[:4]) for s in open_.values()] and all(s[4] is None for s in open_.values()):
            raise ArithmeticError(f"quantile ranges no longer shrink: {before[:3]}")

    out = []
    for p in plan:
        if p is None:
            out.append(None)
            continue
        c, k1, k2, d = p
        lo, hi = state[(c, k1)][4], state[(c, k2)][4]
        out.append(lo if lo == hi or d == 0 else hi if math.isinf(hi) else lo if math.isinf(lo)
                   else lo + (hi - lo) * d if math.isfinite(hi - lo) else lo * (1 - d) + hi * d)
    return out


def _in_range(c: str, lo: float, hi: float):
    return (F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi))


def _long(base: DataFrame, entries: list[Column]) -> DataFrame:
    """A row ``e`` for every entry that is not null, as compiled projections of a row (no array is built and filtered)."""
    names = [f"e{i}" for i in range(len(entries))]
    wide = base.select(*[e.alias(n) for e, n in zip(entries, names)])
    return wide.unpivot([], names, "_entry", "e").where("e is not null").select("e")


def _settle(base: DataFrame, ranges) -> None:
    """Collect the few rows left in each range and pick the ranks directly."""
    entries = [F.when(_in_range(c, lo, hi), F.struct(F.lit(i).alias("r"), F.col(c).alias("x")))
               for i, ((c, lo, hi, _), _) in enumerate(ranges)]
    tab = _long(base, entries).select("e.r", "e.x").toArrow()  # bounded: <= settle_rows per range, Arrow transfer
    values: dict[int, list[float]] = {}
    for r, x in zip(tab.column("r").to_pylist(), tab.column("x").to_pylist()):
        values.setdefault(r, []).append(x)
    for i, (_, states) in enumerate(ranges):
        xs = sorted(values.get(i, []))
        for s in states:
            s[4] = xs[s[5] - s[2]]


def _narrow(base: DataFrame, ranges, buckets: int) -> None:
    """One histogram job over all open ranges; shrink each rank to one bucket."""
    entries = []
    for i, ((c, lo, hi, _), _) in enumerate(ranges):
        x = F.col(c)
        share = (x - F.lit(lo)) / F.lit(hi - lo) if math.isfinite(hi - lo) else (x / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
        b = F.least(F.floor(share * buckets).cast("int"), F.lit(buckets - 1))
        entries.append(F.when(_in_range(c, lo, hi), F.struct(F.lit(i).alias("r"), b.alias("b"), x.alias("x"))))
    hist = (_long(base, entries).select("e.*").groupBy("r", "b")
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"))
            .toArrow())                                # bounded: <= buckets cells per range, Arrow transfer
    cells: dict[int, list] = {}
    for r, b, n, mn, mx in zip(*(hist.column(c).to_pylist() for c in ("r", "b", "n", "mn", "mx"))):
        cells.setdefault(r, []).append((b, n, mn, mx))
    for i, (_, states) in enumerate(ranges):
        cs = sorted(cells.get(i, []))
        for s in states:
            rank = s[5] - s[2]
            seen = 0
            for _, n, mn, mx in cs:
                if rank < seen + n:
                    if mn == mx or rank == seen:
                        s[4] = mn
                    elif rank == seen + n - 1:
                        s[4] = mx
                    else:
                        s[0], s[1], s[2], s[3] = mn, mx, s[2] + seen, n
                    break
                seen += n


def exact_quantile(df: DataFrame, column: str, q: float, **kw) -> float | None:
    return exact_quantiles(df, [(column, q)], **kw)[0]


def weighted_quantiles(df: DataFrame, group: Sequence[str], value: str, weight: str, q: float, buckets: int = 512,
                       settle_rows: int = 4096, broadcast_groups: int = 10_000) -> DataFrame:
    """Exact weighted quantile of every group (M5): ``group..., weight, quantile``.

    The quantile is the least value whose cumulative weight, in order of value,
    reaches ``q`` times the group's weight.  All groups are narrowed at once:
    each pass sums weights by (group, cell of the group's own range), and a
    group goes on with the cell in which the cumulative weight crosses; where at
    most ``settle_rows`` rows are left in it, a window over just these ends the
    search.  A value that many rows share fills a cell of its own and ends it at
    once.  State is a row a group, in Spark.

    Rows with a null or NaN value, or without a positive weight, don't count;
    a null group is a group.  Infinities are values.  Groups without rows are absent.
    """
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"_g{i}") for i, g in enumerate(group)]
    nulls = [F.col(g).isNull().alias(f"_n{i}") for i, g in enumerate(group)]
    own = [f"_g{i}" for i in range(len(group))] + [f"_n{i}" for i in range(len(group))]
    v, w = F.col("_v"), F.col("_w")
    rows = (df.select(*keys, *nulls, F.col(value).cast("double").alias("_v"), F.col(weight).alias("_w"))
            .where(v.isNotNull() & ~F.isnan("_v") & (w > 0)).persist(StorageLevel.MEMORY_AND_DISK))
    try:
        finite = F.when(F.abs(v) < math.inf, v)
        state = rows.groupBy(*own).agg(F.sum("_w").alias("total"), F.count("*").alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
        state = materialise(state.withColumn("below", F.lit(0).cast(rows.schema["_w"].dataType)), "weighted-quantiles")
        n_groups, first, done = state.count(), True, None
        small = (lambda t: F.broadcast(t)) if n_groups <= broadcast_groups else (lambda t: t)
        reached = F.col("below") + F.col("upto") >= F.lit(q) * F.col("total")
        while True:
            open_ = state if first else state.where((F.col("n") > settle_rows) & (F.col("lo") < F.col("hi")))
            closed = state.where(F.lit(False)) if first else state.where((F.col("n") <= settle_rows) | (F.col("lo") >= F.col("hi")))
            done = closed if done is None else done.unionByName(closed)
            if not first and open_.isEmpty():
                break
            share = F.when(F.col("hi") - F.col("lo") < math.inf, (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(
                (v / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
            inner = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(share * buckets).cast("int"), F.lit(buckets - 1))).otherwise(F.lit(0))
            cell = F.when(v == -math.inf, F.lit(-1)).when(v == math.inf, F.lit(buckets)).otherwise(inner)
            met = rows.join(small(open_), own)
            met = met if first else met.where((v >= F.col("lo")) & (v <= F.col("hi")))
            cells = (met.groupBy(*own, "total", "below", cell.alias("cell"))
                     .agg(F.sum("_w").alias("_w"), F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
            along = Window.partitionBy(*own).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # at most buckets + 2 rows
            crossed = (cells.withColumn("upto", F.sum("_w").over(along)).withColumn("last", F.max("cell").over(Window.partitionBy(*own)))
                       .where(reached | (F.col("cell") == F.col("last"))))
            nxt = crossed.groupBy(*own).agg(F.min_by(F.struct("total", (F.col("below") + F.col("upto") - w).alias("below"), "n", "lo", "hi"), "cell").alias("s"))
            state, first = materialise(nxt.select(*own, "s.*"), "weighted-quantiles"), False
        last = rows.join(small(done), own).where((v >= F.col("lo")) & (v <= F.col("hi")))
        # Single-valued cells may hold any number of rows: a row a value first, then a window over the values.
        values = last.groupBy(*own, "total", "below", "_v").agg(F.sum("_w").alias("_w"))
        along = Window.partitionBy(*own).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        ended = (values.withColumn("upto", F.sum("_w").over(along)).groupBy(*own, "total")
                 .agg(F.coalesce(F.min(F.when(reached, v)), F.max("_v")).alias("quantile")))
        names = [F.when(~F.col(f"_n{i}"), F.col(f"_g{i}").cast(df.schema[g].dataType)).alias(g) for i, g in enumerate(group)]
        return materialise(ended.select(*names, F.col("total").alias("weight"), "quantile"), "weighted-quantiles")
    finally:
        rows.unpersist()
