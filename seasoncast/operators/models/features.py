"""Model inputs: feature assembly and PCA of embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embedding_width(df: DataFrame, embedding: str) -> int:
    """Width of an array column, checked over every row (P6): all rows must agree."""
    lo, hi = df.agg(F.min(F.size(embedding)), F.max(F.size(embedding))).first()
    if lo != hi:
        raise ValueError(f"{embedding}: vector widths differ ({lo} vs {hi})")
    return int(hi)


def assemble(df: DataFrame, tabular: Sequence[str], embedding: str | None = None,
             out: str = "features", embedding_dim: int | None = None) -> DataFrame:
    """``[embedding || tabular]`` as one ML vector; nulls kept as NaN."""
    cols = []
    if embedding:
        dim = embedding_dim or embedding_width(df, embedding)
        df = df.withColumn("_emb_vec", array_to_vector(F.col(embedding).cast("array<double>")))
        df = VectorSizeHint(inputCol="_emb_vec", size=dim, handleInvalid="error").transform(df)
        cols.append("_emb_vec")
    df = df.withColumns({c: F.col(c).cast("double") for c in tabular})
    va = VectorAssembler(inputCols=cols + list(tabular), outputCol=out, handleInvalid="keep")
    out_df = va.transform(df)
    return out_df.drop("_emb_vec") if embedding else out_df


class PCAProjection:
    """Centred PCA of an array column (E5).

    MLlib's ``PCAModel`` projects without centring; this subtracts the mean's
    projection and fixes each axis' sign so its largest absolute loading is
    positive, which makes the axes deterministic.  Fit cost: one distributed
    covariance (MLlib) + one mean aggregate; the d x k matrix is small.
    """

    def __init__(self, k: int = 12, input_col: str = "embedding", output_col: str = "pca"):
        self.k, self.input_col, self.output_col = k, input_col, output_col
        self.components: np.ndarray | None = None  # d x k
        self.mean: np.ndarray | None = None
        self.explained_variance: np.ndarray | None = None

    def fit(self, df: DataFrame) -> "PCAProjection":
        v = df.select(array_to_vector(F.col(self.input_col).cast("array<double>")).alias("v"))
        model = PCA(k=self.k, inputCol="v", outputCol="p").fit(v)
        pc = model.pc.toArray()
        flip = np.sign(pc[np.argmax(np.abs(pc), axis=0), np.arange(pc.shape[1])])
        flip[flip == 0] = 1.0
        self.components = pc * flip
        self.explained_variance = model.explainedVariance.toArray()
        dim = pc.shape[0]
        arr = F.col(self.input_col).cast("array<double>")
        means = df.agg(*[F.avg(F.get(arr, i)).alias(f"m{i}") for i in range(dim)]).first()
        self.mean = np.array([means[f"m{i}"] for i in range(dim)])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Project centred rows: ``(x - mean) @ components`` as ``array<double>``, a batch of rows at a time."""
        # d x (k + 1) numbers, in one order of memory, on which the order of the sums depends
        held = df.sparkSession.sparkContext.broadcast((np.ascontiguousarray(self.mean), np.ascontiguousarray(self.components)))

        @F.pandas_udf("array<double>")
        def project(vectors: pd.Series) -> pd.Series:
            mean, components = held.value
            known = vectors.notna().to_numpy()
            out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
            if known.any():
                # Sums in the order of the dimensions, so a row's value does not depend on its batch.
                x = np.stack(vectors[known].to_numpy()).astype(np.float64) - mean
                out[known] = pd.Series(list(np.einsum("nd,dk->nk", x, components)), index=out.index[known])
            return out
        return df.withColumn(self.output_col, project(F.col(self.input_col).cast("array<double>")))

    def spec(self, spark: SparkSession) -> DataFrame:
        """The fitted projection as a table, a row per input dimension."""
        rows = [(i, float(m), [float(x) for x in w]) for i, (m, w) in enumerate(zip(self.mean, self.components))]
        return spark.createDataFrame(rows, "position int, mean double, loadings array<double>")

    @classmethod
    def from_spec(cls, spec: DataFrame, input_col: str = "embedding", output_col: str = "pca") -> "PCAProjection":
        """A projection from its stored table (S5): one row per input dimension."""
        rows = spec.orderBy("position").collect()
        out = cls(len(rows[0]["loadings"]), input_col, output_col)
        out.mean = np.array([r["mean"] for r in rows])
        out.components = np.array([r["loadings"] for r in rows])
        return out
