"""Sequence detector: reconstruction error of the last 20 feature vectors.

A linear autoencoder (principal components of the flattened window) takes the place of a recurrent one: Spark has no
recurrent networks. It keeps the contract (window shape, mean squared error, NULL while warming up, swept threshold),
but its errors, and so its precision and recall, are its own.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from driftwatch.catalog import SEQUENCE_ROWS
from driftwatch.storage import stage

COMPONENTS = 16


def _moments(stored: DataFrame, normal: Callable[[Column], Column], length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(number, mean, covariance) of the flattened windows that end in the wanted rows of `stretches`."""
    wanted = F.transform("rows", lambda row: F.coalesce(normal(row) & ~row["copy"], F.lit(False)))

    def run(batches):
        n, total, products = 0, 0.0, 0.0
        for batch in batches:
            for last, vectors in zip(batch.column(0), batch.column(1), strict=True):
                last, values = last.values.to_numpy(zero_copy_only=False), vectors.values.flatten().to_numpy(zero_copy_only=False)
                width = len(values) // len(vectors.values)
                ends = len(vectors.values) - len(last) + np.flatnonzero(last)  # places of the vectors that windows end with
                starts = ends[ends >= length - 1] - length + 1
                if not len(starts):
                    continue
                x = np.lib.stride_tricks.sliding_window_view(values, length * width)[starts * width]
                n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        if n:
            half = products[np.triu_indices(len(total))].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([half])], ["n", "total", "half"])

    parts = stage(stored.select(wanted.alias("wanted"), "vectors").mapInArrow(run, "n long, total array<double>, half binary"), "moments")
    n, total, half = 0, 0.0, 0.0
    for row in parts.toLocalIterator():
        n, total, half = n + row["n"], total + np.array(row["total"]), half + np.frombuffer(row["half"])
    if n < 2:
        return n, np.zeros(0), np.zeros((0, 0))
    mean, products = total / n, np.zeros((len(total), len(total)))
    products[np.triu_indices(len(total))] = half
    products += np.triu(products, 1).T
    # Vectors are scaled, so their means are small beside their deviations and the difference keeps its digits.
    return n, mean, (products - n * np.outer(mean, mean)) / (n - 1)


@dataclass(frozen=True)
class SequenceModel:
    center: StandardScalerModel
    components: PCAModel

    @staticmethod
    def fit(stored: DataFrame, normal: Callable[[Column], Column], components: int = COMPONENTS, length: int = SEQUENCE_ROWS) -> "SequenceModel":
        """Fit on the windows of `stretches` that end in a row for which `normal` holds.

        One pass adds up what mean and covariance of the flattened windows (560 x 560) need; the driver holds a few such matrices.
        """
        n, mean, covariance = _moments(stored, normal, length)
        if n < 2:
            raise ValueError("too few normal windows to fit the sequence detector")
        center = StandardScaler(withMean=True, withStd=False, inputCol="_window", outputCol="_centered").fit(
            stored.sparkSession.createDataFrame([(Vectors.dense(mean),)], ["_window"]))
        # As many rows with the same covariance: those of its square root, each with both signs, so that their mean is 0.
        sizes, axes = np.linalg.eigh(covariance)
        root = np.sqrt(np.maximum(sizes, 0) * (2 * len(sizes) - 1) / 2)[:, None] * axes.T
        same = stored.sparkSession.createDataFrame([(Vectors.dense(r),) for r in np.concatenate([root, -root])], ["_centered"])
        pca = PCA(k=components, inputCol="_centered", outputCol="_projected").fit(same)
        return SequenceModel(center, pca)

    def add_error(self, df: DataFrame, sequence: str = "sequence", name: str = "lstm_error") -> DataFrame:
        """Mean squared reconstruction error per row; NULL without a full window."""
        width = self.center.mean.size
        empty = F.array_repeat(F.lit(0.0), width)
        window = array_to_vector(F.coalesce(F.flatten(sequence), empty))
        projected = self.components.transform(self.center.transform(df.withColumn("_window", window)))

        def squared_norm(vector):
            return F.aggregate(vector_to_array(vector), F.lit(0.0), lambda acc, x: acc + x * x)
        # The components are orthonormal, so the residual is what the projection does not explain.
        residual = F.greatest(squared_norm("_centered") - squared_norm("_projected"), F.lit(0.0)) / width
        return projected.withColumn(name, F.when(F.col(sequence).isNotNull(), residual)).drop(
            "_window", "_centered", "_projected")


@dataclass(frozen=True)
class GivenComponents:
    """A sequence detector from given orthonormal components of the flattened, scaled window, for instance learned elsewhere."""

    components: tuple[tuple[float, ...], ...]

    def add_error(self, df: DataFrame, sequence: str = "sequence", name: str = "lstm_error") -> DataFrame:
        """Mean squared reconstruction error per row; NULL without a full window."""
        window = F.col("_window")

        def projected(component):
            # Places with weight 0 add nothing.
            terms = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in enumerate(component) if w)
                            ).cast("array<struct<k:int,w:double>>")
            return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.get(window, t["k"]) * t["w"])
        explained = [projected(c) for c in self.components]
        rest = F.aggregate(window, F.lit(0.0), lambda acc, x: acc + x * x) - sum((e * e for e in explained), F.lit(0.0))
        error = F.greatest(rest, F.lit(0.0)) / F.size(window)
        return df.withColumn("_window", F.flatten(sequence)).withColumn(name, F.when(F.col(sequence).isNotNull(), error)).drop("_window")
