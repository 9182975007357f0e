"""Built-in MLlib regressors.

Squared-loss and categorical boosting are ``GBTRegressor`` (distributed
histogram trees); the mixed-input regressor re-aims the reference's neural
network as a factorization machine (``FMRegressor``) over one-hot categories,
scaled numerics and a PCA of the embedding, then shifts it by the
alpha-quantile of its training residuals so it leans towards over-production.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import FMRegressor, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.operators.models.features import embedding_width
from seasoncast.operators.quantile import exact_quantile
from seasoncast.session import materialise


def fit_gbt_squared(df: DataFrame, label: str = "label", features: str = "features", max_iter: int = 50,
                    max_depth: int = 5, step_size: float = 0.1, subsample: float = 0.8, max_bins: int = 256,
                    min_instances: int = 5, validation_col: str | None = None, validation_tol: float = 0.01,
                    weight_col: str | None = None, seed: int = 42):
    """Squared-loss boosted trees with optional validation early stop (M2)."""
    gbt = GBTRegressor(featuresCol=features, labelCol=label, lossType="squared", maxIter=max_iter,
                       maxDepth=max_depth, stepSize=step_size, subsamplingRate=subsample, maxBins=max_bins,
                       minInstancesPerNode=min_instances, validationTol=validation_tol, seed=seed)
    if validation_col:
        gbt.setValidationIndicatorCol(validation_col)
    if weight_col:
        gbt.setWeightCol(weight_col)
    return gbt.fit(df)


def categorical_pipeline(categorical: Sequence[str], numeric: Sequence[str], label: str = "label",
                         max_iter: int = 50, max_depth: int = 8, step_size: float = 0.05, max_bins: int = 512,
                         validation_col: str | None = None, seed: int = 42) -> Pipeline:
    """Boosted trees on native categoricals (M3): indexer metadata marks the
    columns nominal, so MLlib splits them as categories; ``maxBins`` must cover
    the largest dictionary."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep", stringOrderType="alphabetAsc")
           for c in categorical]
    va = VectorAssembler(inputCols=[f"{c}__idx" for c in categorical] + list(numeric), outputCol="_cat_features",
                         handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="_cat_features", labelCol=label, lossType="squared", maxIter=max_iter,
                       maxDepth=max_depth, stepSize=step_size, maxBins=max_bins, seed=seed)
    if validation_col:
        gbt.setValidationIndicatorCol(validation_col)
    return Pipeline(stages=[*idx, va, gbt])


class ShiftedFM:
    """Factorization machine on mixed inputs, shifted to the alpha-quantile (M4)."""

    def __init__(self, categorical: Sequence[str], numeric: Sequence[str], embedding: str | None = None,
                 label: str = "label", alpha: float = 0.8, factor_size: int = 8, max_iter: int = 100,
                 step_size: float = 0.01, clip_zero: bool = True, seed: int = 42):
        self.categorical, self.numeric, self.embedding = list(categorical), list(numeric), embedding
        self.label, self.alpha, self.clip_zero = label, alpha, clip_zero
        idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep") for c in self.categorical]
        ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in self.categorical],
                            outputCols=[f"{c}__ohe" for c in self.categorical], handleInvalid="keep")
        num = VectorAssembler(inputCols=self.numeric, outputCol="_num", handleInvalid="keep")
        scaler = StandardScaler(inputCol="_num", outputCol="_num_scaled", withMean=True, withStd=True)
        inputs = [f"{c}__ohe" for c in self.categorical] + ["_num_scaled"] + (["_emb"] if embedding else [])
        va = VectorAssembler(inputCols=inputs, outputCol="_fm_features", handleInvalid="keep")
        fm = FMRegressor(featuresCol="_fm_features", labelCol=label, factorSize=factor_size, maxIter=max_iter,
                         stepSize=step_size, seed=seed, predictionCol="_fm_pred")
        self.pipeline = Pipeline(stages=[*idx, ohe, num, scaler, va, fm])
        self.model: PipelineModel | None = None
        self.shift = 0.0
        self.embedding_dim: int | None = None

    def _prep(self, df: DataFrame) -> DataFrame:
        if self.embedding:
            if self.embedding_dim is None:
                self.embedding_dim = embedding_width(df, self.embedding)
            df = df.withColumn("_emb", array_to_vector(F.col(self.embedding).cast("array<double>")))
            df = VectorSizeHint(inputCol="_emb", size=self.embedding_dim, handleInvalid="error").transform(df)
        return df

    def fit(self, df: DataFrame) -> "ShiftedFM":
        d = self._prep(df)
        self.model = self.pipeline.fit(d)
        res = self.model.transform(d).select((F.col(self.label) - F.col("_fm_pred")).alias("r"))
        self.shift = exact_quantile(res, "r", self.alpha) or 0.0
        return self

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        p = F.col("_fm_pred") + F.lit(self.shift)
        if self.clip_zero:
            p = F.greatest(p, F.lit(0.0))
        return self.model.transform(self._prep(df)).withColumn(out, p)


def score(model, df: DataFrame, key: str = "ID", out: str = "Production", prediction: str = "prediction",
          clip_zero: bool = False) -> DataFrame:
    """Batch scoring to ``(ID, Production)``."""
    p = F.col(prediction)
    if clip_zero:
        p = F.greatest(p, F.lit(0.0))
    return model.transform(df).select(key, p.cast("double").alias(out))


def trial_table(df: DataFrame, grid: Sequence[tuple[float, int]], label: str = "label",
                features: str = "features", validation_col: str = "is_val", max_iter: int = 50, parallelism: int = 4) -> DataFrame:
    """Hyper-parameter trials (M14): per (eta, depth) -> trees kept by early stop and validation MAE.

    Trials share one written copy of the features and run ``parallelism`` at a
    time, so the small jobs of one fill the gaps of the others.
    """
    rows = materialise(df.select(features, F.col(label).alias("_label"), F.col(validation_col).alias("_val")), "trials").persist()

    def trial(setting):
        eta, depth = setting
        model = fit_gbt_squared(rows, "_label", features, max_iter=max_iter, max_depth=depth, step_size=eta, validation_col="_val")
        mae = model.transform(rows.where("_val")).agg(F.avg(F.abs(F.col("_label") - F.col("prediction")))).first()[0]
        return float(eta), int(depth), len(model.trees), float(mae) if mae is not None else None

    try:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            results = list(pool.map(inheritable_thread_target(df.sparkSession)(trial), list(grid)))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(results, "eta double, depth int, n_trees int, val_mae double")
