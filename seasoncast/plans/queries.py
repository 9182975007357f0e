"""One callable per implemented operator: ``(spark, sf_dir) -> DataFrame``.

Each query reads the whole test tables (through the product-week panel) so
its work grows with the data; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasoncast.functions.parse import bool_to_int, parse_date, parse_vector, to_float32
from seasoncast.functions.vectors import cosine
from seasoncast.functions.measures import (embedding_width, life_cycle_projection, planned_total_demand,
                                           production_gap, season_weeks, uplift)
from seasoncast.operators import aggregate as agg
from seasoncast.operators import blend, clean, encode, profile, sequence, similarity
from seasoncast.operators.models import boosting, mllib, stacking
from seasoncast.operators.models.features import PCAProjection, assemble
from seasoncast.session import materialise
from seasoncast.sources import io
from seasoncast.sources.panel import product_week_panel
from seasoncast.sources.tables import table

REGISTRY: dict = {}


def query(name):
    def wrap(fn):
        REGISTRY[name] = fn
        return fn
    return wrap


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_week_panel(spark, sf_dir)


@query("panel")
def q_panel(spark, sf_dir):
    return panel(spark, sf_dir)


@query("season_target")
def q_season_target(spark, sf_dir):
    return agg.season_target(panel(spark, sf_dir))


@query("product_first")
def q_product_first(spark, sf_dir):
    return agg.product_first(panel(spark, sf_dir))


@query("product_table")
def q_product_table(spark, sf_dir):
    return agg.product_table(panel(spark, sf_dir))


@query("product_season")
def q_product_season(spark, sf_dir):
    return agg.product_season(panel(spark, sf_dir))


@query("color_mean")
def q_color_mean(spark, sf_dir):
    return agg.color_mean(panel(spark, sf_dir))


@query("season_features")
def q_season_features(spark, sf_dir):
    return agg.season_features(agg.product_season(panel(spark, sf_dir)))


@query("season_history")
def q_season_history(spark, sf_dir):
    return agg.season_history(agg.season_features(agg.product_season(panel(spark, sf_dir))))


@query("product_span")
def q_product_span(spark, sf_dir):
    return agg.product_span(panel(spark, sf_dir))


@query("demand_gap")
def q_demand_gap(spark, sf_dir):
    total = planned_total_demand()
    return panel(spark, sf_dir).select(
        "ID", "year", "num_week_iso", total.alias("total_demand"),
        production_gap(total).alias("production_gap"))


# --- cleaning and profiling -------------------------------------------------

SPLIT_YEAR = 2000  # earlier seasons play "train", later seasons "test" in key comparisons


def train_test_keys(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.where(F.col("year") < SPLIT_YEAR), p.where(F.col("year") >= SPLIT_YEAR)


@query("clean_panel")
def q_clean_panel(spark, sf_dir):
    return clean.clean_panel(panel(spark, sf_dir), materialize=True)


@query("value_counts")
def q_value_counts(spark, sf_dir):
    return profile.value_counts(panel(spark, sf_dir), "ID")


@query("top_values")
def q_top_values(spark, sf_dir):
    return profile.top_values(panel(spark, sf_dir), "family", 10)


@query("top_products")
def q_top_products(spark, sf_dir):
    pt = agg.season_target(panel(spark, sf_dir))
    return profile.head(pt, 20, [F.desc("target_demand"), F.asc("ID")])


@query("shape")
def q_shape(spark, sf_dir):
    return profile.shape(panel(spark, sf_dir))


@query("distinct_counts")
def q_distinct_counts(spark, sf_dir):
    return profile.distinct_counts(panel(spark, sf_dir))


@query("constant_per_key")
def q_constant_per_key(spark, sf_dir):
    return profile.constant_per_key(panel(spark, sf_dir), "ID")


@query("column_profile")
def q_column_profile(spark, sf_dir):
    return profile.column_profile(materialise(panel(spark, sf_dir), "panel"))


@query("numeric_profile")
def q_numeric_profile(spark, sf_dir):
    return profile.numeric_profile(panel(spark, sf_dir))


@query("key_overlap")
def q_key_overlap(spark, sf_dir):
    return profile.key_overlap(*train_test_keys(spark, sf_dir))


@query("keys_intersect")
def q_keys_intersect(spark, sf_dir):
    return profile.keys_intersect(*train_test_keys(spark, sf_dir))


@query("keys_except")
def q_keys_except(spark, sf_dir):
    return profile.keys_except(*train_test_keys(spark, sf_dir))


# --- feature specs ----------------------------------------------------------

CATS = ["aggregated_family", "family", "category", "color_name", "color_rgb"]
DATES = ["phase_in", "phase_out"]
SCALED = ["price", "num_stores", "num_sizes", "life_cycle_length", "target_demand"]


def products(spark, sf_dir, materialize: bool = False):
    """Product table with the hold-out flag (train = 80% of product keys by hash).

    ``materialize=True`` writes it once to the shared checkpoint folder, for
    plans that fit several specs on it (each fit is an action)."""
    pt = encode.split_holdout(agg.product_table(panel(spark, sf_dir)))
    return materialise(pt, "products") if materialize else pt


@query("split_holdout")
def q_split_holdout(spark, sf_dir):
    return products(spark, sf_dir).select("ID", "is_train")


@query("label_dictionary")
def q_label_dictionary(spark, sf_dir):
    pt = products(spark, sf_dir)
    return encode.fit_label_dictionary(pt.where("is_train"), CATS)


@query("label_encode_unseen")
def q_label_encode_unseen(spark, sf_dir):
    pt = products(spark, sf_dir, materialize=True)
    spec = encode.fit_label_dictionary(pt.where("is_train"), CATS)
    enc = encode.apply_label_dictionary(pt, spec, ["color_rgb"], policy="clamp", suffix="_clamped")
    enc = encode.apply_label_dictionary(enc, spec, CATS, policy="append")
    return enc.select("ID", *CATS, "color_rgb_clamped")


@query("date_offsets")
def q_date_offsets(spark, sf_dir):
    pt = products(spark, sf_dir, materialize=True)
    spec = encode.fit_date_origins(pt.where("is_train"), DATES)
    return encode.apply_date_origins(pt, spec, DATES).select("ID", *DATES)


@query("calendar_features")
def q_calendar_features(spark, sf_dir):
    pt = products(spark, sf_dir)
    return pt.select("ID",
                     F.month("phase_in").alias("phase_in_month"), F.weekofyear("phase_in").alias("phase_in_week"),
                     F.month("phase_out").alias("phase_out_month"), F.weekofyear("phase_out").alias("phase_out_week"),
                     season_weeks("phase_in", "phase_out").alias("season_weeks"))


@query("zscore")
def q_zscore(spark, sf_dir):
    pt = products(spark, sf_dir, materialize=True)
    spec = encode.fit_scaler(pt.where("is_train"), SCALED)
    return encode.apply_scaler(pt, spec, SCALED, digits=6).select("ID", *SCALED)


@query("recency_weight")
def q_recency_weight(spark, sf_dir):
    pt = products(spark, sf_dir)
    return encode.recency_weights(pt, "phase_out", as_of="2002-01-01", lam=0.2, digits=9).select(
        "ID", "sample_weight")


# --- similarity and blending --------------------------------------------------

K = 10


def knn_items(spark, sf_dir):
    """Every product with the vector its ``vec_id`` names; several products may share one.

    Target = season demand of the product; corpus = products in the training split."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    pt = products(spark, sf_dir).select(
        F.col("ID").alias("id"), "vec_id", F.col("target_demand").alias("target"), "family", "is_train")
    return materialise(pt.join(emb, "vec_id").drop("vec_id"), "knn-items")


def knn_pairs(spark, sf_dir, items=None):
    items = items if items is not None else knn_items(spark, sf_dir)
    return similarity.knn_join(items, items.where("is_train"), k=K, exclude_self=True)


@query("knn_topk")
def q_knn_topk(spark, sf_dir):
    return knn_pairs(spark, sf_dir)


@query("knn_weights")
def q_knn_weights(spark, sf_dir):
    return similarity.neighbor_weights(knn_pairs(spark, sf_dir)).select("query_id", "neighbor_id", "weight")


def knn_forecast(spark, sf_dir, items=None):
    items = items if items is not None else knn_items(spark, sf_dir)
    w = similarity.neighbor_weights(knn_pairs(spark, sf_dir, items))
    return similarity.knn_regress(w, items)


@query("knn_forecast")
def q_knn_forecast(spark, sf_dir):
    return knn_forecast(spark, sf_dir)


def blend_frame(spark, sf_dir):
    """Per item: truth, kNN forecast, family mean and global mean of the training items."""
    items = knn_items(spark, sf_dir)
    train = items.where("is_train")
    fam = train.groupBy("family").agg((F.sum("target") / F.count("target")).alias("family_mean"))
    glob = train.select(F.sum("target") / F.count("target")).scalar()
    knn = knn_forecast(spark, sf_dir, items).withColumnRenamed("query_id", "id")
    return materialise(items.select("id", "target", "family", "is_train")
                       .join(knn, "id")
                       .join(fam, "family", "left")
                       .withColumn("global_mean", glob)
                       .withColumn("family_mean", F.coalesce("family_mean", "global_mean")), "blend")


@query("forecast_mean")
def q_forecast_mean(spark, sf_dir):
    bf = blend_frame(spark, sf_dir)
    fc = {n: bf.select(F.col("id").alias("ID"), F.col(c).alias("Production"))
          for n, c in (("knn", "knn_pred"), ("family", "family_mean"), ("global", "global_mean"))}
    wide = blend.join_forecasts(fc)
    return blend.mean_forecast(wide, [f"Production_{n}" for n in fc])


@query("blend_grid")
def q_blend_grid(spark, sf_dir):
    return blend.blend_grid(blend_frame(spark, sf_dir).where("is_train"), "family_mean", "knn_pred", "target")


@query("blend_best")
def q_blend_best(spark, sf_dir):
    return blend.best_alpha(q_blend_grid(spark, sf_dir))


@query("uplift_clip")
def q_uplift_clip(spark, sf_dir):
    bf = blend_frame(spark, sf_dir)
    alpha = blend.best_alpha(blend.blend_grid(bf.where("is_train"), "family_mean", "knn_pred", "target")).first()
    out = blend.apply_blend(bf.where(~F.col("is_train")), "family_mean", "knn_pred", alpha["alpha"], "blend")
    return out.select(F.col("id").alias("ID"), F.round(uplift("blend", 1.1, 0.0), 6).alias("Production"))


@query("quantile_band")
def q_quantile_band(spark, sf_dir):
    items = knn_items(spark, sf_dir)
    qs = similarity.neighbor_quantiles(knn_pairs(spark, sf_dir, items), items, (0.5, 0.9))
    return blend.quantile_band(qs).select(F.col("query_id").alias("ID"), "p50", "p90", "Production")


@query("metrics_table")
def q_metrics_table(spark, sf_dir):
    bf = blend_frame(spark, sf_dir).where(~F.col("is_train"))
    bf = bf.withColumn("mean3", (F.col("knn_pred") + F.col("family_mean") + F.col("global_mean")) / 3)
    return blend.metrics_table(bf, "target", ["knn_pred", "family_mean", "global_mean", "mean3"], alpha=0.8)


@query("ridge_stack")
def q_ridge_stack(spark, sf_dir):
    return blend.ridge_fit(blend_frame(spark, sf_dir).where("is_train"), "target",
                           ["knn_pred", "family_mean"], alpha=1.0)


# --- sequences and I/O --------------------------------------------------------


@query("week_position")
def q_week_position(spark, sf_dir):
    return sequence.week_position(panel(spark, sf_dir)).select("ID", "year", "num_week_iso", "week_pos")


SEQ_STATIC = ["id_season", "num_sizes", "has_plus_sizes", "price", "life_cycle_length", "vec_id"]


@query("week_sequence")
def q_week_sequence(spark, sf_dir):
    return sequence.week_sequences(panel(spark, sf_dir), ["weekly_sales", "weekly_demand"], static=SEQ_STATIC)


PRODUCT_SCHEMA = ("ID bigint, id_season int, Production double, price double, num_stores int, num_sizes int, "
                  "has_plus_sizes boolean, aggregated_family string, family string, category string, "
                  "color_name string, color_rgb string, phase_in date, phase_out date, life_cycle_length int, "
                  "vec_id bigint, target_demand double")


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    path = io.write_delimited(agg.product_table(panel(spark, sf_dir)), io.scratch_path(spark, "products"), sep=";")
    return io.read_delimited(spark, path, PRODUCT_SCHEMA, sep=";")


@query("forecast_files")
def q_forecast_files(spark, sf_dir):
    fc = q_forecast_mean(spark, sf_dir).select(F.col("ID").alias("id"), F.col("Production").alias("production"))
    path = io.write_delimited(fc, io.scratch_path(spark, "forecasts"), sep=",")
    return io.read_forecasts(spark, [path + "-missing", path])   # first candidate absent: fallback used


@query("spec_roundtrip")
def q_spec_roundtrip(spark, sf_dir):
    pt = products(spark, sf_dir, materialize=True)
    train = pt.where("is_train")
    root = io.scratch_path(spark, "specs")
    io.save_spec(encode.fit_label_dictionary(train, CATS), root, "label_dictionary")
    io.save_spec(encode.fit_date_origins(train, DATES), root, "date_origins")
    labels = io.load_spec(spark, root, "label_dictionary")
    dates = io.load_spec(spark, root, "date_origins")
    return (labels.select(F.lit("label_dictionary").alias("spec"), "column", "value", "code",
                          F.lit(None).cast("date").alias("origin"))
            .unionByName(dates.select(F.lit("date_origins").alias("spec"), "column",
                                      F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("code"),
                                      "origin")))


# --- models (rows-only checks: no SQL form exists for tree fitting) -----------

MODEL_CATS = ["aggregated_family", "family", "category", "color_name"]
TABULAR = ["id_season", *MODEL_CATS, "phase_in", "phase_out", "life_cycle_length", "num_stores", "num_sizes",
           "has_plus_sizes", "price"]


def model_frame(spark, sf_dir, embedding: bool = True, pt=None):
    """Product rows with encoded specs fitted on the training split, plus the embedding.

    ``pt``: the written product table, if there is one."""
    pt = products(spark, sf_dir, materialize=True) if pt is None else pt
    train = pt.where("is_train")
    pt = encode.apply_label_dictionary(pt, encode.fit_label_dictionary(train, MODEL_CATS), MODEL_CATS)
    pt = encode.apply_date_origins(pt, encode.fit_date_origins(train, DATES), DATES)
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pt = (pt.join(emb, "vec_id")
          .withColumn("has_plus_sizes", F.col("has_plus_sizes").cast("int"))
          .withColumn("is_val", ~F.col("is_train"))
          .withColumn("label", F.col("target_demand")))
    return assemble(pt, TABULAR, "embedding" if embedding else None)


@query("gbt_quantile")
def q_gbt_quantile(spark, sf_dir):
    frame = model_frame(spark, sf_dir)
    model = boosting.fit_quantile_boosting(frame, alpha=0.8, n_rounds=15, learning_rate=0.1, max_depth=5,
                                           subsample=0.9, colsample=0.9, validation_col="is_val", patience=5)
    path = io.scratch_path(spark, "gbt_quantile")
    model.save(path)
    loaded = boosting.QuantileBoostingModel.load(path)
    return loaded.transform(frame).select("ID", F.col("prediction").alias("Production"))


@query("gbt_weighted")
def q_gbt_weighted(spark, sf_dir):
    pt = products(spark, sf_dir, materialize=True)
    frame = model_frame(spark, sf_dir, embedding=False, pt=pt)
    dates = pt.select("ID", F.col("phase_out").alias("phase_out_date"))
    frame = encode.recency_weights(frame.join(dates, "ID"), "phase_out_date", as_of="2002-01-01", lam=0.2)
    model = boosting.fit_quantile_boosting(frame, alpha=0.65, n_rounds=10, learning_rate=0.1, max_depth=5,
                                           validation_col="is_val", weight_col="sample_weight", patience=5)
    return model.transform(frame).select("ID", F.col("prediction").alias("Production"))


@query("gbt_squared")
def q_gbt_squared(spark, sf_dir):
    frame = model_frame(spark, sf_dir)
    model = mllib.fit_gbt_squared(frame, max_iter=30, max_depth=5, step_size=0.1, validation_col="is_val")
    return mllib.score(model, frame)


@query("gbt_categorical")
def q_gbt_categorical(spark, sf_dir):
    # Written once: the dictionary sizes, every indexer, the trees and the scoring read it.
    pt = products(spark, sf_dir, materialize=True).withColumn("is_val", ~F.col("is_train")).withColumn("label", F.col("target_demand"))
    cats = encode.categorical_columns(pt.drop("color_rgb"), extra=["id_season"])
    pt = encode.stringify_categoricals(pt, cats, token="NA")
    # maxBins must cover the largest dictionary (+1 slot for unseen values)
    largest = profile.distinct_counts(pt, cats).agg(F.max("n_unique")).first()[0]
    pipe = mllib.categorical_pipeline(cats, ["price", "num_stores", "num_sizes", "life_cycle_length"],
                                      max_iter=30, max_depth=6, max_bins=max(32, largest + 1),
                                      validation_col="is_val")
    return mllib.score(pipe.fit(pt), pt)


@query("fm_mixed")
def q_fm_mixed(spark, sf_dir):
    frame = model_frame(spark, sf_dir, embedding=False)
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("emb"))
    pca = PCAProjection(k=12, input_col="emb", output_col="emb_pca")
    train_emb = frame.where("is_train").select("vec_id").join(emb, "vec_id")
    frame = pca.fit(train_emb).transform(frame.join(emb, "vec_id"))
    fm = mllib.ShiftedFM(MODEL_CATS, ["price", "num_stores", "num_sizes", "life_cycle_length", "phase_in"],
                         embedding="emb_pca", alpha=0.8, max_iter=50)
    fm.fit(frame.where("is_train"))
    return fm.transform(frame).select("ID", F.col("prediction").alias("Production"))


@query("pca_embedding")
def q_pca_embedding(spark, sf_dir):
    pt = products(spark, sf_dir).select("ID", "vec_id", "is_train")
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = pt.join(emb, "vec_id")
    pca = PCAProjection(k=12).fit(rows.where("is_train"))
    return pca.transform(rows).select("ID", "pca")


@query("trial_table")
def q_trial_table(spark, sf_dir):
    return mllib.trial_table(model_frame(spark, sf_dir), [(0.05, 3), (0.05, 5), (0.1, 3), (0.1, 5)], max_iter=20)


@query("stacked")
def q_stacked(spark, sf_dir):
    frame = model_frame(spark, sf_dir)

    def gbt_base(train):
        m = mllib.fit_gbt_squared(train, max_iter=15, max_depth=4)
        return lambda x: m.transform(x)

    def quantile_base(train):
        m = boosting.fit_quantile_boosting(train, alpha=0.8, n_rounds=5, patience=None)
        return lambda x: m.transform(x)

    predict, _ = stacking.fit_stack(frame, {"gbt": gbt_base, "quantile": quantile_base}, holdout_col="is_val")
    return predict(frame).select("ID", F.col("stacked").alias("Production"))


# --- remaining scalar operators -------------------------------------------------


@query("life_cycle_projection")
def q_life_cycle_projection(spark, sf_dir):
    ps = agg.product_season(panel(spark, sf_dir))
    return ps.select("ID", "season_year", life_cycle_projection("phase_in_first", "phase_out_first",
                                                                "weekly_demand_mean").alias("projected_demand"))


@query("category_widths")
def q_category_widths(spark, sf_dir):
    spec = encode.fit_label_dictionary(products(spark, sf_dir).where("is_train"), CATS)
    sizes = spec.groupBy("column").agg(F.count(F.lit(1)).cast("int").alias("n_classes"))
    return sizes.withColumn("factor_width", embedding_width("n_classes"))


# --- profile report parts and the pseudo-target ridge -------------------------------
PROFILE_PAIRS = ["weekly_sales", "weekly_demand", "price", "num_stores", "Production"]


@query("numeric_histogram")
def q_numeric_histogram(spark, sf_dir):
    return profile.histogram(panel(spark, sf_dir), "price", bins=20)


@query("correlations")
def q_correlations(spark, sf_dir):
    return profile.correlations(panel(spark, sf_dir), PROFILE_PAIRS)


@query("ridge_pseudo")
def q_ridge_pseudo(spark, sf_dir):
    """Ridge on standardised forecasts against their own mean (D9): no ground truth used."""
    bf = blend_frame(spark, sf_dir)
    cols = ["knn_pred", "family_mean"]
    pseudo = bf.withColumn("pseudo", (F.col("knn_pred") + F.col("family_mean")) / 2)
    z = encode.apply_scaler(pseudo, encode.fit_scaler(pseudo, cols), cols)
    return blend.ridge_fit(z, "pseudo", cols, alpha=1.0)


@query("gbt_band")
def q_gbt_band(spark, sf_dir):
    """p50 and p90 boosters blended 0.7 / 0.3 (M11 on trained models)."""
    frame = model_frame(spark, sf_dir, embedding=False)
    preds = {}
    for a in (0.5, 0.9):
        m = boosting.fit_quantile_boosting(frame, alpha=a, n_rounds=8, learning_rate=0.1, max_depth=4,
                                           validation_col="is_val", patience=None)
        preds[a] = m.transform(frame).select("ID", F.col("prediction").alias(f"p{int(a * 100)}"))
    both = preds[0.5].join(preds[0.9], "ID")
    return blend.quantile_band(both, "p50", "p90", digits=None).select("ID", "p50", "p90", "Production")


# --- text parsing, style flags, histories and the prepared test table ------------------


@query("parse_dates")
def q_parse_dates(spark, sf_dir):
    """ISO, day-first and broken date texts, a third of the orders each."""
    day, third = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 3
    text = (F.when(third == 0, F.date_format(day, "yyyy-MM-dd")).when(third == 1, F.date_format(day, "d/M/yyyy"))
            .otherwise(F.concat(F.lit("on "), F.date_format(day, "yyyy-MM-dd"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("written"), parse_date(text).alias("day"))


@query("parse_vectors")
def q_parse_vectors(spark, sf_dir):
    """Vector texts with a broken last element back to arrays."""
    text = F.concat(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", "), F.lit(",n/a"))
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", parse_vector(text).alias("vec"))
    same = F.zip_with("embedding", F.slice("vec", 1, F.size("embedding")), lambda x, y: to_float32(y).eqNullSafe(x))
    return emb.select("vec_id", F.size("vec").alias("n"), F.element_at("vec", -1).isNull().alias("last_is_null"),
                      F.size(F.filter(same, lambda x: x)).alias("n_same"))


@query("cosine_pairs")
def q_cosine_pairs(spark, sf_dir):
    """Native cosine of every vector and the one with the next id."""
    emb = table(spark, sf_dir, "embeddings")
    a = emb.select("vec_id", F.col("embedding").alias("a"))
    b = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine("a", "b"), 9).alias("similarity"))


@query("style_flags")
def q_style_flags(spark, sf_dir):
    """Outerwear and occasion flags on texts derived from the product key."""
    k = F.col("ID") % 6
    ps = (agg.product_season(panel(spark, sf_dir))
          .withColumn("moment_first", F.when(k < 2, "Semi formal").when(k < 4, "casual wear").when(k == 4, "Sport"))
          .withColumn("aggregated_family_first", F.concat(F.col("aggregated_family_first"), F.when(k % 3 == 0, " long coat").otherwise(""))))
    return agg.season_features(ps).select("ID", "season_year", "is_outerwear", "is_formal", "is_casual")


@query("season_dataset")
def q_season_dataset(spark, sf_dir):
    """Identifiers, target and the declared features and categories that exist."""
    ps = agg.season_features(agg.product_season(panel(spark, sf_dir)))
    wanted = ["ID", "season_year", "Production_max", "sell_through_ratio", "stores_per_size", "is_outerwear",
              "is_formal", "moment_first", "family_first", "category_first"]
    return clean.keep_existing(ps, wanted)


@query("early_stop")
def q_early_stop(spark, sf_dir):
    """Best round of the weekly mean demand read as a validation history, patience 10."""
    weeks = (panel(spark, sf_dir).groupBy((F.col("year") * 53 + F.col("num_week_iso")).alias("round"))
             .agg(F.round(F.sum("weekly_demand") / F.count("weekly_demand"), 9).alias("val_loss")))
    return blend.early_stop(weeks, patience=10)


@query("prepared_test_table")
def q_prepared_test_table(spark, sf_dir):
    """A delimited test file with artefact columns, brought into the shape that the stored specs ask for.

    Written and read with ``;``, quoted comma-separated vectors, unseen
    categories, a renamed key; required columns and the vector width are checked
    over all rows (P1-P8, P10, P11, S2, S4, S5, F1, F9, F26)."""
    pt = products(spark, sf_dir, materialize=True)
    emb = table(spark, sf_dir, "embeddings")
    train, root = pt.where("is_train"), io.scratch_path(spark, "test-specs")
    cats = ["family", "category", "color_name"]
    io.save_spec(encode.fit_label_dictionary(train, cats), root, "labels")
    io.save_spec(encode.fit_date_origins(train, DATES), root, "dates")
    width = emb.select(F.max(F.size("embedding")).alias("width"))
    io.save_spec(width, root, "width")
    shape = train.select("ID", *cats, *DATES, "price", "num_stores", "has_plus_sizes")
    io.save_spec(spark.createDataFrame([(i, c) for i, c in enumerate(shape.columns)], "position int, name string"), root, "columns")

    text = F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")
    raw = (pt.where("not is_train").join(emb, "vec_id")
           .select(F.col("ID").alias("Key"), *cats, *DATES, "price", "num_stores", "has_plus_sizes", "id_season", text.alias("image"))
           .withColumn("color_name", F.when(F.col("Key") % 5 == 0, "unheard of").otherwise(F.col("color_name")))
           .withColumns({"Unnamed: 0": F.lit(1), "notes": F.lit("a;b")}))
    path = io.write_delimited(raw, io.scratch_path(spark, "test-table"), sep=";")
    got = io.read_delimited(spark, path, raw.schema, sep=";")
    got = clean.drop_if_present(clean.drop_prefixed(got), ["notes", "absent"])
    got = clean.equals(clean.rename(got, {"Key": "ID"}), "id_season", 1)
    order = [r["name"] for r in io.load_spec(spark, root, "columns").orderBy("position").collect()]
    clean.require_columns(got, order, "the test table")
    got = got.withColumns({"image": parse_vector("image"), "has_plus_sizes": bool_to_int("has_plus_sizes")})
    dim = io.load_spec(spark, root, "width").first()["width"]
    if clean.check_vector_width(got, "image", dim).limit(1).count():
        raise ValueError(f"vectors of the test table are not all {dim} wide")
    total = F.round(F.aggregate("image", F.lit(0.0), lambda acc, x: acc + to_float32(x).cast("double")), 6).alias("image_sum")
    got = encode.apply_label_dictionary(got, io.load_spec(spark, root, "labels"), cats, policy="clamp")
    got = encode.apply_date_origins(got, io.load_spec(spark, root, "dates"), DATES)
    assert clean.column_difference(got, shape) == ["id_season", "image"]
    return got.select(*order, total)


# --- ensembles of trained models -----------------------------------------------------


@query("ensemble_trained")
def q_ensemble_trained(spark, sf_dir):
    """Mean of three trained models: each forecast is written, read back and joined by product (M9 on files)."""
    frame = materialise(model_frame(spark, sf_dir, embedding=False), "model-frame")
    booster = boosting.fit_quantile_boosting(frame, alpha=0.65, n_rounds=8, max_depth=4, validation_col="is_val", patience=None)
    squared = mllib.fit_gbt_squared(frame, max_iter=10, max_depth=4, step_size=0.1, validation_col="is_val")
    deep = boosting.fit_quantile_boosting(frame, alpha=0.5, n_rounds=6, max_depth=6, validation_col="is_val", patience=None)
    forecasts = {"band": booster.transform(frame).select("ID", F.col("prediction").alias("Production")),
                 "squared": mllib.score(squared, frame),
                 "median": deep.transform(frame).select("ID", F.col("prediction").alias("Production"))}
    stored = {n: io.read_forecasts(spark, io.write_delimited(f.select("ID", "Production"), io.scratch_path(spark, f"forecast-{n}"), sep=","))
              for n, f in forecasts.items()}
    wide = blend.join_forecasts(stored)
    return wide.join(blend.mean_forecast(wide, [f"Production_{n}" for n in stored]), "ID")


@query("blend_booster_knn")
def q_blend_booster_knn(spark, sf_dir):
    """The alpha grid between a trained booster and the kNN forecast, chosen on hold-out products."""
    frame = materialise(model_frame(spark, sf_dir, embedding=False), "model-frame")
    model = boosting.fit_quantile_boosting(frame, alpha=0.65, n_rounds=8, max_depth=4, validation_col="is_val", patience=None)
    booster = model.transform(frame).select(F.col("ID").alias("query_id"), "label", "is_val", F.col("prediction").alias("booster"))
    both = booster.join(knn_forecast(spark, sf_dir), "query_id")
    return blend.blend_grid(both.where("is_val"), "booster", "knn_pred", "label")


# --- stored scaler and projection -------------------------------------------------------


@query("zscore_stored")
def q_zscore_stored(spark, sf_dir):
    """Scaling by a stored spec (S4, S5 for the scaler)."""
    pt = products(spark, sf_dir, materialize=True)
    root = io.scratch_path(spark, "scaler")
    io.save_spec(encode.fit_scaler(pt.where("is_train"), SCALED), root, "scaler")
    return encode.apply_scaler(pt, io.load_spec(spark, root, "scaler"), SCALED, digits=6).select("ID", *SCALED)


@query("pca_boost")
def q_pca_boost(spark, sf_dir):
    """Twelve components of the embedding plus the tabular columns in a quantile booster (E5, E6, M1);
    the projection is stored and loaded between fit and use."""
    frame = materialise(model_frame(spark, sf_dir, embedding=False).drop("features"), "pca-frame")
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("emb"))
    rows = frame.join(emb, "vec_id")
    root = io.scratch_path(spark, "pca")
    fitted = PCAProjection(k=12, input_col="emb", output_col="emb_pca").fit(rows.where("is_train"))
    io.save_spec(fitted.spec(spark), root, "pca")
    pca = PCAProjection.from_spec(io.load_spec(spark, root, "pca"), "emb", "emb_pca")
    data = assemble(pca.transform(rows).drop("embedding"), TABULAR, "emb_pca", embedding_dim=12)
    model = boosting.fit_quantile_boosting(data, alpha=0.8, n_rounds=8, max_depth=4, validation_col="is_val", patience=None)
    return model.transform(data).select("ID", F.col("prediction").alias("Production"))
