"""Feature specs: fit on training rows -> small spec DataFrame -> transform.

A fitted spec is an ordinary DataFrame in long form ``(column, key, value)``
or ``(column, value, code)``; it can be written with ``sources.io.save_spec``
and applied by a join.  Joins against a spec use a broadcast only after the
bytes of that column's dictionary have been checked against ``BROADCAST_BYTES``;
larger ones fall back to a salted shuffle join, column by column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.functions.measures import months_between_days, recency_weight, unzscore, zscore
from seasoncast.functions.parse import date_column, fill_category
from seasoncast.operators.joins import salted_left_join
from seasoncast.operators.prefix import leaf_bits, leaf_of, prefix_sums
from seasoncast.session import cut_lineage, materialise

BROADCAST_BYTES = 32 << 20
UNKNOWN = "UNKNOWN"  # fixed value: label given to unseen categories


# --- E7: hold-out split -----------------------------------------------------

def holdout_flag(key: str = "ID", seed: int = 42, train_share_hex: str = "cccccccc") -> Column:
    """Deterministic 80/20 split from a hash of the key.

    Independent of partitioning and engine: ``md5(key || ':' || seed)`` prefix
    below ``train_share_hex`` (0xcccccccc / 2^32 = 0.8) is training."""
    h = F.substr(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.lit(1), F.lit(8))
    return h < F.lit(train_share_hex)


def split_holdout(df: DataFrame, key: str = "ID", seed: int = 42) -> DataFrame:
    return df.withColumn("is_train", holdout_flag(key, seed))


# --- E1 / E2 / J4: label dictionary -----------------------------------------

def fit_label_dictionary(df: DataFrame, cols: Sequence[str], missing_token: str = "nan") -> DataFrame:
    """Sorted label codes per column, all columns in one job.

    ``(column, value)`` pairs are range-partitioned and sorted; each partition
    numbers its own values, and a per-(partition, column) count table
    (partitions x columns rows) gives the offsets.  No column's dictionary is
    gathered into a single task, however many distinct values it has.
    """
    pairs = (df.select(*[fill_category(c, missing_token).alias(c) for c in cols])
             .unpivot([], list(cols), "column", "value")
             .distinct())
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range partition of every pair is written down before it is used twice: a
    # range exchange that is planned again draws its bounds anew.
    ranged = materialise(pairs.repartitionByRange(n_parts, "column", "value")
                         .withColumn("_pid", F.spark_partition_id()), "label-ranges")
    local = Window.partitionBy("_pid", "column").orderBy("value")
    numbered = ranged.withColumn("_local", F.row_number().over(local) - 1)
    counts = ranged.groupBy("_pid", "column").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("column").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "column",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    spec = (numbered.join(F.broadcast(offsets), ["_pid", "column"])  # partitions x columns rows
            .select("column", "value", (F.col("_off") + F.col("_local")).cast("int").alias("code")))
    # A fitted spec is used several times (sizes, broadcast check, one join per
    # column): materialise it once in the shared checkpoint folder.
    return cut_lineage(spec)


def apply_label_dictionary(df: DataFrame, spec: DataFrame, cols: Sequence[str],
                           policy: str = "append", missing_token: str = "nan",
                           suffix: str = "", broadcast_bytes: int = BROADCAST_BYTES, salt: int = 32) -> DataFrame:
    """Replace categories by codes.

    Unseen values map to ``UNKNOWN``: its code if it is a class, otherwise
    ``N`` (appended last).  ``policy="clamp"`` then limits codes to ``N - 1`` (0 if there are no classes).
    The per-column sizes are one row per column and become literals.  A
    dictionary of over ``broadcast_bytes`` is joined with a salted shuffle join, so a category value holding a large share of the rows is spread
    over ``salt`` tasks.
    """
    spec = spec.where(F.col("column").isin(list(cols)))
    sizes = {r["column"]: (r["n"], r["unk"], r["bytes"]) for r in spec.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("value") == UNKNOWN, F.col("code"))).alias("unk"),
        F.sum(F.octet_length("value") + 16).alias("bytes")).collect()}
    out = df
    for c in cols:
        n, unk, size = sizes.get(c, (0, None, 0))
        d = spec.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        if size <= broadcast_bytes:
            out = out.join(F.broadcast(d), fill_category(c, missing_token) == F.col(f"_v_{c}"), "left")
        else:
            out = salted_left_join(out, d, fill_category(c, missing_token), f"_v_{c}", salt)
        code = F.coalesce(F.col(f"_c_{c}"), F.lit(unk if unk is not None else n))
        if policy == "clamp":
            code = F.least(code, F.lit(max(n - 1, 0)))  # an empty dictionary leaves one class
        out = out.withColumn(c + suffix, code.cast("int")).drop(f"_v_{c}", f"_c_{c}")
    return out


# --- M3: ordered target statistics -----------------------------------------------

def target_stats_spec(train: DataFrame, cols: Sequence[str], label: str, missing_token: str = "NA") -> DataFrame:
    """Label sum and count of every category, and the label's mean: ``column, value, total, n, prior``."""
    prior = train.agg((F.sum(label) / F.count(label)).alias("p")).first()["p"]
    pairs = (train.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), *[fill_category(c, missing_token).alias(c) for c in cols])
             .unpivot(["_y"], list(cols), "column", "value"))
    spec = pairs.groupBy("column", "value").agg(F.sum("_y").alias("total"), F.count("*").alias("n"))
    return cut_lineage(spec.withColumn("prior", F.lit(prior).cast("double")))


def ordered_target_stats(train: DataFrame, cols: Sequence[str], label: str, key: str = "ID", seed: int = 42, strength: float = 1.0,
                         missing_token: str = "NA", suffix: str = "_ts", digits: int | None = None) -> DataFrame:
    """Categories of training rows as the smoothed mean label of the rows before them (M3).

    ``(total before + strength x prior) / (n before + strength)``, where rows of a
    category come in the order of a hash of their key, so no row sees its own
    label.  The running sums are taken in leaves of the hash order, so a
    category that holds most of the rows is spread over many tasks.  Rows of one
    key come in the order of their label; a null label adds nothing and gets a
    value all the same.
    """
    cols = list(cols)
    n, prior = train.agg(F.count("*"), F.sum(label) / F.count(label)).first()
    if not n:
        return train.withColumns({c + suffix: F.lit(None).cast("double") for c in cols})
    bits = leaf_bits(n)
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    # The row's number in its key keeps repeated keys apart on the way back.
    rank = F.row_number().over(Window.partitionBy(key).orderBy(label))
    base = cut_lineage(train.withColumns({"_digest": digest, "_row": rank}))
    long = (base.select(key, "_digest", "_row", F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("_y"),
                        F.col(label).isNotNull().cast("long").alias("_one"), leaf_of("_digest", bits).alias("_leaf"),
                        *[fill_category(c, missing_token).alias(c) for c in cols])
            .unpivot([key, "_digest", "_row", "_y", "_one", "_leaf"], cols, "column", "value"))
    run = prefix_sums(long, ["column", "value"], "_leaf", ["_digest", "_row"], ["_y", "_one"], bits)
    stat = (F.col("before__y") + F.lit(strength * (prior or 0.0))) / (F.col("before__one") + F.lit(strength))
    stat = F.round(stat, digits) if digits is not None else stat
    wide = (run.withColumn("_stat", stat).groupBy(F.col(key).alias("_key"), F.col("_row").alias("_rank"))
            .agg(*[F.max(F.when(F.col("column") == c, F.col("_stat"))).alias(c + suffix) for c in cols]))
    return (base.join(wide, base[key].eqNullSafe(wide["_key"]) & (base["_row"] == wide["_rank"]))
            .drop("_digest", "_row", "_key", "_rank"))


def apply_target_stats(df: DataFrame, spec: DataFrame, cols: Sequence[str], strength: float = 1.0, missing_token: str = "NA",
                       suffix: str = "_ts", digits: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, salt: int = 32) -> DataFrame:
    """Categories of new rows as the smoothed mean label of all training rows; an unseen one gets the prior."""
    sizes = {r["column"]: r["bytes"] for r in spec.groupBy("column").agg(F.sum(F.octet_length("value") + 24).alias("bytes")).collect()}
    first = spec.select("prior").first()
    prior = first["prior"] if first else None
    out = df
    for c in cols:
        stat = (F.col("total") + F.lit(strength) * F.col("prior")) / (F.col("n") + F.lit(strength))
        d = spec.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), stat.alias(f"_s_{c}"))
        if sizes.get(c, 0) <= broadcast_bytes:
            out = out.join(F.broadcast(d), fill_category(c, missing_token) == F.col(f"_v_{c}"), "left")
        else:
            out = salted_left_join(out, d, fill_category(c, missing_token), f"_v_{c}", salt)
        value = F.coalesce(F.col(f"_s_{c}"), F.lit(prior).cast("double"))
        out = out.withColumn(c + suffix, F.round(value, digits) if digits is not None else value).drop(f"_v_{c}", f"_s_{c}")
    return out


# --- E3 / J5: date origins --------------------------------------------------

def fit_date_origins(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum parsed date per column (A12) -> spec ``(column, origin)``."""
    wide = df.agg(*[F.min(date_column(df, c)).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "origin")


def apply_date_origins(df: DataFrame, spec: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Days since the stored origin; unparsable -> 0.

    The spec has one row per column; its origins become literals."""
    origin = {r["column"]: r["origin"] for r in spec.collect()}
    return df.withColumns({c: F.coalesce(F.datediff(date_column(df, c), F.lit(origin[c])), F.lit(0)).cast("double")
                           for c in cols})


# --- E4 / E11: standard scaler ------------------------------------------------

def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population std per column (A13, N14) -> spec ``(column, mean, std)``."""
    wide = df.agg(*[F.struct(F.avg(F.col(c).cast("double")).alias("mean"),
                             F.stddev_pop(F.col(c).cast("double")).alias("std")).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "s").select("column", "s.mean", "s.std")


def apply_scaler(df: DataFrame, spec: DataFrame, cols: Sequence[str], inverse: bool = False,
                 digits: int | None = None) -> DataFrame:
    """z-score (or its inverse) with a zero std treated as 1."""
    stats = {r["column"]: (r["mean"], r["std"]) for r in spec.collect()}  # one row per column
    fn = unzscore if inverse else zscore
    out = {}
    for c in cols:
        mean, std = stats[c]
        v = fn(c, F.lit(mean), F.lit(std))
        out[c] = F.round(v, digits) if digits is not None else v
    return df.withColumns(out)


# --- E4 / E11: scaling of sequences -----------------------------------------------

def sequence_moments(rows: DataFrame, sequences: Sequence[str], statics: Sequence[str] = (), vectors: Sequence[str] = (),
                     length: str = "seq_len") -> DataFrame:
    """Moments over all weekly rows that a factored table stands for: ``column, n, mean, m2``.

    ``sequences`` are array columns with a value a week, ``statics`` numbers
    that hold for each of the row's ``length`` weeks, ``vectors`` arrays whose
    entries do (``column`` is then ``name[i]``).  A row gives count, mean and sum
    of squared deviations of its own array, inside the row; moments of parts add
    up (:func:`merge_moments`).  Nothing is repeated by week.  Nulls and NaN don't count.
    """
    def known(x):
        return x.isNotNull() & ~F.isnan(x)

    wide = {}
    for c in sequences:
        values = F.filter(F.transform(c, lambda x: x.cast("double")), known)
        mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(values), F.lit(1))
        m2 = F.aggregate(F.transform(values, lambda x: (x - F.col("_mean." + c)) * (x - F.col("_mean." + c))), F.lit(0.0), lambda a, x: a + x)
        wide[c] = (F.when(F.size(values) > 0, mean), F.size(values).cast("long"), m2)
    means = rows.withColumn("_mean", F.struct(*[m.alias(c) for c, (m, _, _) in wide.items()])) if wide else rows
    entries = [F.struct(F.lit(c).alias("column"), n.alias("n"), F.col("_mean." + c).alias("mean"), m2.alias("m2")) for c, (_, n, m2) in wide.items()]
    weeks = F.col(length).cast("long")
    for c in statics:
        x = F.col(c).cast("double")
        entries.append(F.struct(F.lit(c).alias("column"), F.when(known(x), weeks).otherwise(0).alias("n"), x.alias("mean"), F.lit(0.0).alias("m2")))
    parts = F.array(*entries) if entries else F.array().cast("array<struct<column:string,n:bigint,mean:double,m2:double>>")
    for v in vectors:
        own = F.transform(v, lambda x, i: F.struct(F.concat(F.lit(f"{v}["), i.cast("string"), F.lit("]")).alias("column"),
                                                   F.when(known(x.cast("double")), weeks).otherwise(0).alias("n"), x.cast("double").alias("mean"), F.lit(0.0).alias("m2")))
        parts = F.concat(parts, own)
    return merge_moments(means.select(F.explode(parts).alias("p")).select("p.*"))


def merge_moments(parts: DataFrame) -> DataFrame:
    """Moments of the union of the parts: ``column, n, mean, m2`` from rows of the same shape."""
    some = parts.where("n > 0")
    mean = some.groupBy("column").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    centred = some.join(F.broadcast(mean.select("column", F.col("mean").alias("_m"))), "column")  # a row a column
    spread = centred.groupBy("column").agg(F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_m")) * (F.col("mean") - F.col("_m"))).alias("m2"))
    return mean.join(spread, "column").select("column", "n", "mean", "m2")


def moments_spec(moments: DataFrame) -> DataFrame:
    """Moments as a scaler spec ``(column, mean, std)``, population std."""
    return moments.select("column", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"))


def scale_sequences(df: DataFrame, spec: DataFrame, cols: Sequence[str], inverse: bool = False, digits: int | None = None) -> DataFrame:
    """z-score of every value of array columns, or its inverse; a zero std counts as 1."""
    stats = {r["column"]: (r["mean"], r["std"]) for r in spec.where(F.col("column").isin(list(cols))).collect()}  # a row a column

    def step(mean, std):
        unit = std or 1.0
        value = (lambda x: x * unit + mean) if inverse else (lambda x: (x - mean) / unit)
        return (lambda x: F.round(value(x.cast("double")), digits)) if digits is not None else (lambda x: value(x.cast("double")))
    return df.withColumns({c: F.transform(c, step(*stats[c])) for c in cols})


# --- E10: categorical set ------------------------------------------------------

def categorical_columns(df: DataFrame, extra: Sequence[str] = ()) -> list[str]:
    """String columns plus named extras, in schema order."""
    named = set(extra)
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" or f.name in named]


def stringify_categoricals(df: DataFrame, cols: Sequence[str], token: str = "NA") -> DataFrame:
    """Cast to string and fill missing with ``token``."""
    return df.withColumns({c: fill_category(c, token) for c in cols})


# --- E12: recency weights ------------------------------------------------------

def recency_weights(df: DataFrame, date_col: str = "phase_out", as_of: str = "2002-01-01",
                    lam: float = 0.2, out: str = "sample_weight", digits: int | None = None) -> DataFrame:
    """``exp(-lambda * months since date)`` with an explicit ``as_of`` date.

    ``digits`` rounds the weight (``exp`` may differ in the last bit between math libraries)."""
    months = months_between_days(F.to_date(F.lit(as_of)), date_column(df, date_col))
    w = recency_weight(months, lam)
    return df.withColumn(out, F.round(w, digits) if digits is not None else w)
