"""Registered queries of indexes, weighted and ordered statistics, packed sequences, report parts and stored models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from seasoncast.functions.parse import parse_vector
from seasoncast.operators import aggregate as agg
from seasoncast.operators import ann, blend, clean, encode, profile, sequence, similarity
from seasoncast.operators.models import boosting, mllib, stacking
from seasoncast.operators.models.features import PCAProjection, assemble
from seasoncast.operators.models.mixed_net import MixedNet
from seasoncast.operators.quantile import weighted_quantiles
from seasoncast.plans.queries import DATES, MODEL_CATS, SCALED, SPLIT_YEAR, K, blend_frame, knn_items, panel, products, query
from seasoncast.session import materialise
from seasoncast.sources import io
from seasoncast.sources.tables import table

NUMBERS = ["price", "num_stores", "num_sizes", "life_cycle_length"]
WEEKLY = ["weekly_sales", "weekly_demand"]

# --- neighbours ---------------------------------------------------------------------


@query("knn_index")
def q_knn_index(spark, sf_dir):
    """Cells calibrated to find 97 of 100 neighbours, held against the exact join for every product."""
    items = knn_items(spark, sf_dir)
    index = ann.CellIndex.fit(items.where("is_train"))
    index.calibrate(K, recall=0.97)
    index = ann.CellIndex.load(spark, index.path)
    found = ann.recall(index.search(items, K, exclude_self=True), similarity.knn_join(items, items.where("is_train"), k=K))
    return found.select("n_queries", "n_neighbors", (F.col("n_found") >= 0.95 * F.col("n_neighbors")).alias("found_95"))


@query("knn_index_all")
def q_knn_index_all(spark, sf_dir):
    """All cells probed: the exact neighbours."""
    items = knn_items(spark, sf_dir)
    index = ann.CellIndex.fit(items.where("is_train"), rounds=3, part_rows=512)
    return index.search(items, K, probes=len(index.centres), exclude_self=True)


@query("knn_total_demand")
def q_knn_total_demand(spark, sf_dir):
    """kNN forecast of the planned total, life cycle x weekly demand of a product's first week."""
    items = knn_items(spark, sf_dir)
    first = agg.product_first(panel(spark, sf_dir)).select(F.col("ID").alias("id"), (F.col("life_cycle_length") * F.col("weekly_demand")).alias("total"))
    pairs = similarity.knn_join(items, items.where("is_train"), k=K)
    return similarity.knn_regress(similarity.neighbor_weights(pairs), first, target_col="total", out="total_demand")


# --- weighted and ordered statistics ----------------------------------------------------


@query("weighted_quantile")
def q_weighted_quantile(spark, sf_dir):
    """0.65 quantile of season demand by family, weighted by recency in millionths."""
    pt = encode.recency_weights(products(spark, sf_dir).where("is_train"), "phase_out", as_of="2002-01-01", lam=0.2)
    pt = pt.withColumn("w", F.round(F.col("sample_weight") * 1_000_000).cast("long") + 1)
    return weighted_quantiles(pt, ["family"], "target_demand", "w", 0.65)


STAT_CATS = ["family", "category", "color_name"]


@query("ordered_stats")
def q_ordered_stats(spark, sf_dir):
    """Categories of training products as the mean demand of the products before them (M3)."""
    train = products(spark, sf_dir, materialize=True).where("is_train")
    return encode.ordered_target_stats(train, STAT_CATS, "target_demand", digits=6).select("ID", *[f"{c}_ts" for c in STAT_CATS])


@query("target_stats")
def q_target_stats(spark, sf_dir):
    """Categories of held-out products as the mean demand of the training ones, by a stored table."""
    pt = products(spark, sf_dir, materialize=True)
    root = io.scratch_path(spark, "target-stats")
    io.save_spec(encode.target_stats_spec(pt.where("is_train"), STAT_CATS, "target_demand"), root, "stats")
    held = encode.apply_target_stats(pt.where("not is_train"), io.load_spec(spark, root, "stats"), STAT_CATS, digits=6)
    return held.select("ID", *[f"{c}_ts" for c in STAT_CATS])


@query("gbt_ordered")
def q_gbt_ordered(spark, sf_dir):
    """Boosted trees on ordered statistics of the categories, early stop on the held-out products (M3)."""
    pt = products(spark, sf_dir, materialize=True)
    train, held = pt.where("is_train"), pt.where("not is_train")
    stats = encode.target_stats_spec(train, MODEL_CATS, "target_demand")
    rows = encode.ordered_target_stats(train, MODEL_CATS, "target_demand").unionByName(encode.apply_target_stats(held, stats, MODEL_CATS))
    rows = rows.withColumn("is_val", ~F.col("is_train")).withColumn("label", F.col("target_demand"))
    frame = materialise(assemble(rows, [*NUMBERS, *[f"{c}_ts" for c in MODEL_CATS]]), "ordered-frame")
    return mllib.score(mllib.fit_gbt_squared(frame, max_iter=20, max_depth=5, validation_col="is_val"), frame)


# --- sequences ----------------------------------------------------------------------------


@query("packed_batches")
def q_packed_batches(spark, sf_dir):
    """Weekly sequences in batches of 64 products of like length, flat with offsets."""
    return sequence.packed_batches(sequence.week_sequences(panel(spark, sf_dir), WEEKLY, pad=False), WEEKLY)


@query("padded_batches")
def q_padded_batches(spark, sf_dir):
    """The batches padded to their own longest product, with the share of padding."""
    batches = sequence.packed_batches(sequence.week_sequences(panel(spark, sf_dir), ["weekly_demand"], pad=False), ["weekly_demand"])
    padded = sequence.pad_batches(batches, ["weekly_demand"])
    return padded.select("batch", "weekly_demand_padded", (F.size("weekly_demand_padded") - F.element_at("offsets", -1)).alias("n_padding"))


@query("weekly_vectors")
def q_weekly_vectors(spark, sf_dir):
    """A row a week: the week's figures, the product's figures and its vector, from two factored tables."""
    weekly, blocks = sequence.factored_rows(panel(spark, sf_dir), WEEKLY, ["num_sizes", "price", "life_cycle_length"], table(spark, sf_dir, "embeddings"))
    rows = sequence.expand_rows(weekly, blocks, WEEKLY)
    tail = F.aggregate(F.slice("values", 6, F.size("values") - 5), F.lit(0.0), lambda a, x: a + x)
    return rows.select("ID", "week_pos", "week_key", "target", F.size("values").alias("n_values"), F.slice("values", 1, 5).alias("figures"),
                       F.round(tail, 6).alias("vector_sum"))


def _sequences(spark, sf_dir):
    seqs = sequence.week_sequences(panel(spark, sf_dir), WEEKLY, static=["price", "vec_id"], pad=False)
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return materialise(encode.split_holdout(seqs.join(emb, "vec_id")), "sequences")


@query("sequence_moments")
def q_sequence_moments(spark, sf_dir):
    """Mean and std of all entries of the training products' weekly rows, none of which is built.

    The moments of two halves of the products are merged."""
    train = _sequences(spark, sf_dir).where("is_train")
    parts = [encode.sequence_moments(train.where(F.col("ID") % 2 == h), [f"{f}_seq" for f in WEEKLY], ["price"], ["embedding"]) for h in (0, 1)]
    merged = encode.moments_spec(encode.merge_moments(parts[0].unionByName(parts[1])))
    return merged.select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("sequence_scaled")
def q_sequence_scaled(spark, sf_dir):
    """Weekly sequences of all products scaled by the training ones."""
    seqs, cols = _sequences(spark, sf_dir), [f"{f}_seq" for f in WEEKLY]
    spec = encode.moments_spec(encode.sequence_moments(seqs.where("is_train"), cols))
    return encode.scale_sequences(seqs, spec, cols, digits=6).select("ID", *cols)


@query("sequence_restored")
def q_sequence_restored(spark, sf_dir):
    """Sequences and targets scaled, and back in their own units by the stored specs."""
    seqs, cols = _sequences(spark, sf_dir), [f"{f}_seq" for f in WEEKLY]
    root = io.scratch_path(spark, "sequence-scaler")
    train = seqs.where("is_train")
    io.save_spec(encode.moments_spec(encode.sequence_moments(train, cols)), root, "sequences")
    io.save_spec(encode.fit_scaler(train, ["target"]), root, "target")
    by_week, by_target = io.load_spec(spark, root, "sequences"), io.load_spec(spark, root, "target")
    scaled = encode.apply_scaler(encode.scale_sequences(seqs, by_week, cols), by_target, ["target"])
    back = encode.apply_scaler(encode.scale_sequences(scaled, by_week, cols, inverse=True, digits=6), by_target, ["target"], inverse=True, digits=6)
    return back.select("ID", "target", *cols)


@query("zscore_inverse")
def q_zscore_inverse(spark, sf_dir):
    """Product figures scaled and back."""
    pt = products(spark, sf_dir, materialize=True)
    spec = encode.fit_scaler(pt.where("is_train"), SCALED)
    back = encode.apply_scaler(encode.apply_scaler(pt, spec, SCALED), spec, SCALED, inverse=True, digits=9)
    return back.select("ID", *SCALED)


# --- report parts ---------------------------------------------------------------------------

RANKED = ["weekly_sales", "weekly_demand", "price", "num_stores"]


@query("spearman")
def q_spearman(spark, sf_dir):
    return profile.spearman(panel(spark, sf_dir), RANKED)


@query("average_ranks")
def q_average_ranks(spark, sf_dir):
    return profile.average_ranks(panel(spark, sf_dir), ["weekly_demand", "num_stores"])


@query("cramers_v")
def q_cramers_v(spark, sf_dir):
    return profile.cramers_v(panel(spark, sf_dir), ["aggregated_family", *STAT_CATS])


SKETCHED = ["ID", "family", "price", "weekly_demand"]


@query("sketch_profile")
def q_sketch_profile(spark, sf_dir):
    """Profiles stored by year, those of later years merged and held against exact counts and ranks."""
    p = materialise(panel(spark, sf_dir), "panel")
    path = io.scratch_path(spark, "profiles")
    numeric = ["price", "weekly_demand"]
    profile.sketch_profile(p, ["year"], SKETCHED, numeric).write.parquet(path)
    later = p.where(F.col("year") >= SPLIT_YEAR)
    merged = profile.merge_profiles(spark.read.parquet(path).where(F.col("year") >= SPLIT_YEAR))
    exact = profile.distinct_counts(later, SKETCHED).withColumnRenamed("n_unique", "truth")
    medians = merged.where("q50 is not null").select("column", "q50")
    values = later.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], numeric, "column", "v")
    # The share of rows below and up to the value has to reach the wanted one within a percent.
    place = (values.join(F.broadcast(medians), "column").groupBy("column")
             .agg((F.avg((F.col("v") < F.col("q50")).cast("int")) - 0.01 <= 0.5).alias("low"), (F.avg((F.col("v") <= F.col("q50")).cast("int")) + 0.01 >= 0.5).alias("high")))
    out = merged.join(exact, "column").join(place, "column", "left")
    return out.select("column", "rows", "missing", (F.abs(F.col("n_unique") - F.col("truth")) <= 0.05 * F.col("truth") + 1).alias("unique_near"),
                      F.coalesce(F.col("low") & F.col("high"), F.lit(True)).alias("median_near"))


# --- files and columns ---------------------------------------------------------------------------


@query("csv_quoted")
def q_csv_quoted(spark, sf_dir):
    """A comma file with quoted vectors, doubled quotes, blanks and line breaks in fields, written and read."""
    vector = F.concat_ws(",", F.col("p_size").cast("string"), F.lit("-0.5"), (F.col("p_partkey") % 10).cast("string"))
    note = F.concat(F.lit(' "'), F.col("p_brand"), F.lit('", size; '), F.col("p_size").cast("string"), F.lit("\n"), F.col("p_name"), F.lit(' ""  '))
    written = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ID"), note.alias("note"), vector.alias("vector"))
    path = io.write_delimited(written, io.scratch_path(spark, "quoted"), sep=",")
    got = io.read_delimited(spark, path, "ID bigint, note string, vector string", sep=",")
    return got.select("ID", "note", parse_vector("vector").alias("vector"))


@query("forecast_bucketed")
def q_forecast_bucketed(spark, sf_dir):
    """Three forecasts in tables bucketed by product, joined without an exchange."""
    bf = blend_frame(spark, sf_dir)
    stored = {}
    for n, c in (("knn", "knn_pred"), ("family", "family_mean"), ("global", "global_mean")):
        path = io.write_bucketed(bf.select(F.col("id").alias("ID"), F.col(c).alias("Production")), io.scratch_path(spark, f"bucketed-{n}"), buckets=8)
        stored[n] = io.read_bucketed(spark, path)
    return blend.mean_forecast(blend.join_forecasts(stored), [f"Production_{n}" for n in stored])


@query("typed_columns")
def q_typed_columns(spark, sf_dir):
    """The panel without its text columns."""
    return clean.select_by_type(panel(spark, sf_dir))


@query("reindexed_columns")
def q_reindexed_columns(spark, sf_dir):
    """Columns in a training schema's order and types, absent ones null."""
    from pyspark.sql import types as T
    shape = T.StructType([T.StructField("num_stores", T.LongType()), T.StructField("fabric", T.StringType()), T.StructField("ID", T.LongType()),
                          T.StructField("waist", T.DoubleType()), T.StructField("price", T.DoubleType())])
    return clean.reindex_columns(products(spark, sf_dir), shape)


@query("category_union")
def q_category_union(spark, sf_dir):
    """Two halves with different columns, united by name, with their categories as text."""
    pt = products(spark, sf_dir).select("ID", *STAT_CATS, "id_season", "color_rgb", "price", "is_train")
    both = pt.where("is_train").drop("color_rgb").unionByName(pt.where("not is_train").drop("category"), allowMissingColumns=True)
    cats = encode.categorical_columns(both, extra=["id_season"])
    return encode.stringify_categoricals(both, cats).select("ID", *cats)


@query("assembled_features")
def q_assembled_features(spark, sf_dir):
    """Vector and numbers of a product in one feature vector."""
    pt = products(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return assemble(pt, NUMBERS, "embedding").select("ID", vector_to_array("features").alias("features"))


# --- models -----------------------------------------------------------------------------------


@query("pca_rotation")
def q_pca_rotation(spark, sf_dir):
    """All components of the vectors: a rotation, so squared lengths from the mean stay (E5)."""
    emb = table(spark, sf_dir, "embeddings")
    width = emb.select(F.max(F.size("embedding"))).first()[0]
    rows = PCAProjection(k=width).fit(emb).transform(emb)
    return rows.select("vec_id", F.round(F.aggregate("pca", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"))


def fixed_booster():
    """Two trees over price, stores, sizes and life cycle: a model as stored, not fitted."""
    def tree(feature, threshold, left, right, value):
        return dict(feature=feature, threshold=threshold, left=left, right=right, value=value)
    first = tree([0, 3, -1, -1, -1], [2000.0, 150.0, 0.0, 0.0, 0.0], [1, 2, 0, 0, 0], [4, 3, 0, 0, 0], [0.0, 0.0, 12.5, -3.25, 40.0])
    second = tree([2, -1, 1, -1, -1], [3.0, 0.0, 1.0, 0.0, 0.0], [1, 0, 3, 0, 0], [2, 0, 4, 0, 0], [0.0, 8.0, 0.0, -6.0, 2.0])
    return boosting.QuantileBoostingModel(alpha=0.8, learning_rate=0.1, init=800.0, trees=[first, second], feature_subsets=[None, None])


@query("booster_scores")
def q_booster_scores(spark, sf_dir):
    """A stored booster of known trees scores every product."""
    path = io.scratch_path(spark, "fixed-booster")
    fixed_booster().save(path)
    frame = assemble(products(spark, sf_dir), NUMBERS)
    scored = boosting.QuantileBoostingModel.load(path).transform(frame)
    return scored.select("ID", F.round("prediction", 6).alias("Production"))


@query("net_pinball")
def q_net_pinball(spark, sf_dir):
    """Mixed-input network fitted on the pinball loss, stored and loaded between fit and use."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("emb"))
    frame = products(spark, sf_dir, materialize=True).join(emb, "vec_id").withColumn("is_val", ~F.col("is_train"))
    net = MixedNet(MODEL_CATS, NUMBERS, embedding="emb", label="target_demand", alpha=0.8).fit(frame, "is_val")
    loaded = MixedNet.load(spark, net.save(io.scratch_path(spark, "net")))
    return loaded.transform(frame).select("ID", F.col("prediction").alias("Production"))


@query("train_store_score")
def q_train_store_score(spark, sf_dir):
    """Train, store model and specs, then score a separate delimited test file to a forecast file."""
    pt, root = products(spark, sf_dir, materialize=True), io.scratch_path(spark, "artefacts")
    train = pt.where("is_train")
    io.save_spec(encode.fit_label_dictionary(train, MODEL_CATS), root, "labels")
    io.save_spec(encode.fit_date_origins(train, DATES), root, "dates")
    order = [*MODEL_CATS, *DATES, *NUMBERS]
    io.save_spec(spark.createDataFrame(list(enumerate(order)), "position int, name string"), root, "columns")

    def prepared(rows):
        columns = [r["name"] for r in io.load_spec(spark, root, "columns").orderBy("position").collect()]
        rows = clean.require_columns(rows, ["ID", *columns], "the rows")
        rows = encode.apply_label_dictionary(rows, io.load_spec(spark, root, "labels"), MODEL_CATS, policy="clamp")
        rows = encode.apply_date_origins(rows, io.load_spec(spark, root, "dates"), DATES)
        rows = rows.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
        return assemble(rows, columns, "embedding")

    model = boosting.fit_quantile_boosting(prepared(train.withColumn("label", F.col("target_demand"))), alpha=0.8, n_rounds=8, max_depth=4, patience=None)
    model.save(f"{root}/model")

    test = pt.where("not is_train").drop("target_demand", "is_train", "Production").withColumn("Unnamed: 28", F.lit(None).cast("string"))
    file = io.write_delimited(test, io.scratch_path(spark, "test-file"), sep=";")
    got = clean.drop_prefixed(io.read_delimited(spark, file, test.schema, sep=";"))
    loaded = boosting.QuantileBoostingModel.load(f"{root}/model")
    forecast = mllib.score(loaded, prepared(got), clip_zero=True)
    return io.read_forecasts(spark, io.write_delimited(forecast, io.scratch_path(spark, "forecast"), sep=","))


def _three_bases():
    def squared(train):
        m = mllib.fit_gbt_squared(train, max_iter=10, max_depth=4)
        return lambda x: m.transform(x)

    def quantile(train):
        m = boosting.fit_quantile_boosting(train, alpha=0.5, n_rounds=5, max_depth=4, learning_rate=0.3, patience=None)
        return lambda x: m.transform(x)

    def categories(train):
        spec = encode.target_stats_spec(train, MODEL_CATS, "label")
        inputs = [*NUMBERS, *[f"{c}_ts" for c in MODEL_CATS]]
        rows = encode.ordered_target_stats(train, MODEL_CATS, "label")
        m = mllib.fit_gbt_squared(assemble(rows, inputs, out="_ordered"), features="_ordered", max_iter=10, max_depth=4)
        drop = ["_ordered", *[f"{c}_ts" for c in MODEL_CATS]]
        return lambda x: m.transform(assemble(encode.apply_target_stats(x, spec, MODEL_CATS), inputs, out="_ordered")).drop(*drop)

    return {"squared": squared, "quantile": quantile, "categories": categories}


def _level_one(spark, sf_dir):
    pt = products(spark, sf_dir, materialize=True).withColumn("is_val", ~F.col("is_train")).withColumn("label", F.col("target_demand"))
    frame = materialise(assemble(pt, NUMBERS).select("ID", "label", "is_val", "features", *MODEL_CATS, *NUMBERS), "stack-frame")
    bases = _three_bases()
    return frame, bases, stacking.level_one(frame, bases)


@query("stack_comparison")
def q_stack_comparison(spark, sf_dir):
    """Three trained bases and the ridge over them on held-out products."""
    _, bases, level1 = _level_one(spark, sf_dir)
    return stacking.compare_stack(level1, bases)


@query("stack_invariants")
def q_stack_invariants(spark, sf_dir):
    """What holds for any bases: the ridge leaves no mean residual and is no worse than the best base where it was fitted (M8)."""
    _, bases, level1 = _level_one(spark, sf_dir)
    table = stacking.compare_stack(level1, bases, alpha=1e-9)
    stacked = F.col("model") == "stacked"
    out = table.agg(F.max(F.when(stacked, F.col("n"))).alias("n"), F.max(F.when(stacked, F.abs(F.col("bias")))).alias("bias"),
                    (F.max(F.when(stacked, F.col("rmse"))) <= F.min(F.when(~stacked, F.col("rmse"))) + 1e-6).alias("no_worse"))
    return out
