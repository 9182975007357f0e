"""Weekly sequences per product.

A product's weekly rows are bounded by the calendar (at most 53 per year), so
one ``collect_list`` per product is a bounded group even when the product
holds a large share of the raw order lines (those were combined map-side when
the panel was built).  Order is (year, week), not week alone (D5).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.operators.prefix import leaf_bits, leaf_of, prefix_sums
from seasoncast.session import materialise

ORDER = ("year", "num_week_iso")


def week_position(panel: DataFrame, key: str = "ID", order: Sequence[str] = ORDER) -> DataFrame:
    """1-based position of each week inside its product's sequence."""
    w = Window.partitionBy(key).orderBy(*order)
    return panel.withColumn("week_pos", F.row_number().over(w).cast("int"))


def _part(name: str):
    return lambda r: r[name]


def _field(name: str):
    return lambda r: r[name].cast("double")


def week_sequences(panel: DataFrame, features: Sequence[str], key: str = "ID", order: Sequence[str] = ORDER,
                   target: str | None = "Production", pad_to: int | None = None, pad_value: float = 0.0,
                   static: Sequence[str] = (), pad: bool = True) -> DataFrame:
    """One row per product: static attributes (first non-null), ordered weekly
    feature arrays, length, right-padded copies (E8, O1, P15).

    ``pad_to=None`` pads to the longest sequence in the data (one scalar
    subquery); sequences are never truncated.  ``pad=False`` leaves the copies out
    (:func:`packed_batches` pads by batch).
    """
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in features])))
    aggs = [rows.alias("_rows")]
    for c in static:
        first = F.when(F.col(c).isNotNull(), F.struct(*[F.col(o) for o in order]))
        aggs.append(F.min_by(F.col(c), first).alias(c))
    if target:
        ordering = F.when(F.col(target).isNotNull(), F.struct(*[F.col(c) for c in order]))
        aggs.append(F.min_by(F.col(target), ordering).alias("target"))
    g = panel.groupBy(key).agg(*aggs)
    wk = F.transform("_rows", lambda r: r[order[0]] * 100 + r[order[1]]) if len(order) == 2 else \
        F.transform("_rows", lambda r: r[order[0]])
    cols = [F.col(key), *[F.col(c) for c in static], F.size("_rows").cast("int").alias("seq_len"),
            wk.alias("week_keys")]
    cols += [F.transform("_rows", _field(c)).alias(f"{c}_seq") for c in features]
    if target:
        cols.append("target")
    out = g.select(*cols)
    if not pad:
        return out
    if pad_to is None:
        out = materialise(out, "sequences")  # read twice: for the longest one and for the rows
    length = F.lit(pad_to) if pad_to is not None else out.select(F.max("seq_len")).scalar()
    for c in features:
        seq = F.col(f"{c}_seq")
        out = out.withColumn(f"{c}_padded", F.concat(
            seq, F.array_repeat(F.lit(pad_value), F.greatest(length - F.size(seq), F.lit(0)))))
    return out


def packed_batches(sequences: DataFrame, features: Sequence[str], key: str = "ID", batch_rows: int = 64, seed: int = 42) -> DataFrame:
    """Batches of products of like length, as flat values plus offsets.

    ``sequences`` is a :func:`week_sequences` table.  Products are ordered by
    length, then by a hash of their key, and cut into batches of ``batch_rows``;
    the place of a product is a running count in leaves (length, hash), so no
    task sorts all of them.  A batch holds ``batch, n_rows, max_len, ids, targets,
    offsets`` (n_rows + 1 positions) and a ``<feature>_values`` array each; product i
    has the values from ``offsets[i]`` to ``offsets[i + 1]``.
    """
    n, longest = sequences.agg(F.count("*"), F.max("seq_len")).first()
    bits = leaf_bits(n or 0)
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    target = F.col("target") if "target" in sequences.columns else F.lit(None).cast("double")
    rows = sequences.select(F.col(key).alias("id"), target.alias("target"), "seq_len", *[f"{f}_seq" for f in features], digest.alias("_digest"),
                            F.lit(0).alias("_all"), F.lit(1).cast("long").alias("one"))
    rows = materialise(rows.withColumn("_leaf", F.col("seq_len").cast("long") * (1 << bits) + leaf_of("_digest", bits)), "sequences")
    wide = bits + max(1, int(longest or 0).bit_length())
    placed = prefix_sums(rows, ["_all"], "_leaf", ["_digest", "id"], ["one"], wide)
    packed = (placed.withColumn("batch", F.floor(F.col("before_one") / batch_rows).cast("long"))
              .groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("before_one", "id", "target", "seq_len", *[f"{f}_seq" for f in features]))).alias("_r")))
    lengths = F.transform("_r", lambda r: r["seq_len"])
    offsets = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return packed.select("batch", F.size("_r").alias("n_rows"), F.array_max(lengths).alias("max_len"), F.transform("_r", lambda r: r["id"]).alias("ids"),
                         F.transform("_r", lambda r: r["target"]).alias("targets"), offsets.alias("offsets"),
                         *[F.flatten(F.transform("_r", _part(f"{f}_seq"))).alias(f"{f}_values") for f in features])


def pad_batches(batches: DataFrame, features: Sequence[str], pad_value: float = 0.0) -> DataFrame:
    """Add ``<feature>_padded``: n_rows x max_len values, every product padded to the longest of its own batch."""
    place = F.sequence(F.lit(0), F.col("n_rows") - 1)

    def padded(values):
        def row(i):
            n = F.element_at("offsets", i + 2) - F.element_at("offsets", i + 1)
            return F.concat(F.slice(values, F.element_at("offsets", i + 1) + 1, n), F.array_repeat(F.lit(pad_value), F.col("max_len") - n))
        return F.flatten(F.transform(place, row))
    return batches.withColumns({f"{f}_padded": padded(f"{f}_values") for f in features})


def factored_rows(panel: DataFrame, features: Sequence[str], static: Sequence[str], vectors: DataFrame | None = None, vec_key: str = "vec_id",
                  vec_col: str = "embedding", key: str = "ID", order: Sequence[str] = ORDER) -> tuple[DataFrame, DataFrame]:
    """Weekly rows in two tables (P15): ``(weekly, static)``.

    ``weekly`` has a product's weeks as ragged arrays, ``static`` its numbers and
    its vector once, as ``block``; :func:`expand_rows` joins them at the read.
    """
    seqs = week_sequences(panel, features, key, order, target="Production" if "Production" in panel.columns else None,
                          static=[*static, *([vec_key] if vectors is not None else [])], pad=False)
    seqs = materialise(seqs, "factored")
    numbers = F.array(*[F.col(c).cast("double") for c in static]) if static else F.array().cast("array<double>")
    if vectors is None:
        blocks = seqs.select(key, numbers.alias("block"))
    else:
        held = vectors.select(F.col(vec_key), F.col(vec_col).cast("array<double>").alias("_v"))
        blocks = seqs.join(held, vec_key, "left").select(key, F.concat(numbers, F.coalesce("_v", F.array().cast("array<double>"))).alias("block"))
    return seqs.drop(*static, vec_key), blocks


def expand_rows(weekly: DataFrame, blocks: DataFrame, features: Sequence[str], key: str = "ID") -> DataFrame:
    """A row a week: ``key, week_pos, week_key, target, values`` with ``values`` = the week's features, then the product's block."""
    rows = weekly.join(blocks, key)
    weeks = F.arrays_zip("week_keys", *[f"{f}_seq" for f in features])
    out = rows.select(key, "block", *(["target"] if "target" in weekly.columns else []), F.posexplode(weeks).alias("_p", "_w"))
    return out.select(key, (F.col("_p") + 1).cast("int").alias("week_pos"), F.col("_w.week_keys").alias("week_key"),
                      *(["target"] if "target" in weekly.columns else []),
                      F.concat(F.array(*[F.col(f"_w.{f}_seq") for f in features]), F.col("block")).alias("values"))
