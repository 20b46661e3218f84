"""Distance-to-centre, linear reconstruction and random-feature one-class scores."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.vectors import squared_distance
from tidemark.operators.encoding import exact_quantiles

SNAP = 0.1  # centre coordinates closer to 0 than this are moved to +-0.1


def centre_vector(train: DataFrame, vector: str) -> DataFrame:
    """One row, ``centre``: the mean vector with small coordinates snapped away from 0."""
    dense = array_to_vector(F.col(vector).cast("array<double>"))
    means = train.select(Summarizer.mean(dense).alias("m")).select(vector_to_array("m").alias("m"))
    snapped = F.transform("m", lambda c: F.when((c > 0) & (c < SNAP), SNAP).when((c < 0) & (c > -SNAP), -SNAP).otherwise(c))
    return means.select(snapped.alias("centre"))


def centre_distance(df: DataFrame, vector: str, centre: DataFrame, name: str = "dist") -> DataFrame:
    """Add the squared distance to the centre (one vector, a scalar subquery)."""
    held = df.withColumn("_centre", centre.scalar())
    return held.withColumn(name, squared_distance(F.col(vector).cast("array<double>"), F.col("_centre"))).drop("_centre")


def radius_quantile(distances: DataFrame, nu: float, dist: str = "dist") -> DataFrame:
    """One row, ``radius``: the (1-nu) quantile of the distance (linear, exact)."""
    roots = distances.select(F.sqrt(dist).alias("root"))
    return exact_quantiles(roots, [], "root", [1.0 - nu]).select(F.col("q0").alias("radius"))


def svdd_score(train: DataFrame, test: DataFrame, vector: str, nu: float | None = None) -> DataFrame:
    """Add ``score``: squared distance to the train centre, minus R^2 if ``nu`` is given."""
    centre = centre_vector(train, vector)
    scored = centre_distance(test, vector, centre, "score")
    if nu is None:
        return scored
    radius = radius_quantile(centre_distance(train, vector, centre), nu).scalar()
    return scored.withColumn("score", F.col("score") - radius * radius)


def svdd_objective(train: DataFrame, vector: str, nu: float) -> DataFrame:
    """Soft-boundary objective ``R^2 + mean(max(0, dist - R^2)) / nu`` over the train rows."""
    away = centre_distance(train, vector, centre_vector(train, vector))
    radius = radius_quantile(away, nu).scalar()
    square = radius * radius
    over = away.withColumn("r2", square)
    return over.agg(
        F.max("r2").alias("r2"),
        (F.max("r2") + F.avg(F.greatest(F.lit(0.0), F.col("dist") - F.col("r2"))) / nu).alias("objective"),
    )


def vector_std_params(train: DataFrame, vector: str) -> DataFrame:
    """One row, ``params``: mean and population deviation per position (0 replaced by 1)."""
    dense = array_to_vector(F.col(vector).cast("array<double>"))
    found = train.select(Summarizer.metrics("mean", "variance", "count").summary(dense).alias("s"))
    n = F.col("s.count")
    spread = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n))
    return found.select(
        F.struct(
            vector_to_array("s.mean").alias("mean"),
            F.transform(spread, lambda d: F.when(d == 0, F.lit(1.0)).otherwise(d)).alias("std"),
        ).alias("params")
    )


def standardise_vector(df: DataFrame, vector: str, params: DataFrame) -> DataFrame:
    held = df.withColumn("_p", params.scalar())
    moved = F.zip_with(F.col(vector).cast("array<double>"), F.col("_p.mean"), lambda x, m: x - m)
    return held.withColumn(vector, F.zip_with(moved, F.col("_p.std"), lambda x, s: x / s)).drop("_p")


def moments(train: DataFrame, vector: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums, sums of products) of a vector column: one partial row per Arrow batch, added up on Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, dim)
                cells = np.concatenate([[len(x)], x.sum(0), (x.T @ x)[np.triu_indices(dim)]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "x"])

    rows = train.select(F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    cells = rows.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    found = np.zeros(1 + dim + dim * (dim + 1) // 2)  # numbers that depend on the vector's length alone
    for r in cells.collect():
        found[r["cell"]] = r["x"]
    products = np.zeros((dim, dim))
    products[np.triu_indices(dim)] = found[1 + dim :]
    return int(found[0]), found[1 : 1 + dim], products + np.triu(products, 1).T


def principal_axes(matrix: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """(dim, at most k) orthonormal axes of the largest eigenvalues of a covariance, by power iteration and deflation.

    The matrix is squared ``rounds`` times, so eigenvalues that lie close together are told apart as well; equal ones
    give some axis of their space. Fewer axes come back if nothing is left to explain.
    """
    rest, axes, whole = matrix.copy(), [], max(float(np.trace(matrix)), 0.0)
    for _ in range(min(k, len(matrix))):
        if np.trace(rest) <= 1e-12 * whole:
            break
        power = rest / np.trace(rest)
        for _ in range(rounds):
            power = power @ power
            power /= np.trace(power)
        axis = power[:, np.argmax(np.diag(power))]
        axis = axis / np.linalg.norm(axis)
        axes.append(axis)
        rest = rest - (axis @ rest @ axis) * np.outer(axis, axis)
    return np.linalg.qr(np.array(axes).T)[0] if axes else np.zeros((len(matrix), 0))


class PcaModel:
    """Mean, deviation (0 replaced by 1) and the first ``k`` axes of standardised train rows."""

    def __init__(self, train: DataFrame, vector: str, k: int):
        seen = train.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("dim")).first()
        if seen is None:
            raise ValueError("no train rows")
        n, sums, products = moments(train, vector, seen["dim"])
        self.vector, self.mean = vector, sums / n
        covariance = products / n - np.outer(self.mean, self.mean)
        spread = np.sqrt(np.maximum(np.diag(covariance), 0.0))
        self.std = np.where(spread > 0, spread, 1.0)
        self.axes = principal_axes(covariance / np.outer(self.std, self.std), k)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row, (mean, std, axes), which depends on the vector's length alone."""
        row = (self.mean.tolist(), self.std.tolist(), self.axes.tolist())
        return spark.createDataFrame([row], "mean array<double>, std array<double>, axes array<array<double>>")

    @classmethod
    def of(cls, table: DataFrame, vector: str) -> PcaModel:
        """A model fitted before, from its ``table``."""
        model, row = cls.__new__(cls), table.first()
        model.vector, model.mean, model.std = vector, np.array(row["mean"]), np.array(row["std"])
        model.axes = np.array(row["axes"], dtype=float).reshape(len(row["mean"]), -1)
        return model

    def score(self, test: DataFrame) -> DataFrame:
        """Add ``score``: squared error of rebuilding a standardised row from its code; null for a null vector."""
        mean, std, axes = self.mean, self.std, self.axes

        @F.pandas_udf("double")
        def error(vectors: pd.Series) -> pd.Series:
            known = vectors.notna()
            out = np.full(len(vectors), np.nan)
            if known.any():
                z = (np.array(vectors[known].tolist(), dtype=float) - mean) / std
                out[known] = ((z - z @ axes @ axes.T) ** 2).sum(1)
            return pd.Series(out)

        found = test.withColumn("score", error(F.col(self.vector).cast("array<double>")))
        return found.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def pca_reconstruction(train: DataFrame, test: DataFrame, vector: str, k: int) -> DataFrame:
    """Add ``score``: squared error of rebuilding a standardised row from ``k`` components."""
    return PcaModel(train, vector, k).score(test)


def uniform_draw(seed, *parts) -> float:
    """Uniform number in (0, 1) from md5 of the seed and the parts."""
    digest = hashlib.md5("|".join(str(p) for p in (seed, *parts)).encode()).hexdigest()
    return (int(digest[:8], 16) + 0.5) / 4294967296.0


def normal_draw(seed, *parts) -> float:
    return math.sqrt(-2.0 * math.log(uniform_draw(seed, *parts, "u"))) * math.cos(2.0 * math.pi * uniform_draw(seed, *parts, "v"))


def fourier_weights(d: int, n_features: int, gamma: float, seed) -> tuple[np.ndarray, np.ndarray]:
    """Seeded (d, D) directions and D shifts of random features for exp(-gamma |x-y|^2)."""
    normal = [[normal_draw(seed, f, j) for f in range(n_features)] for j in range(d)]
    shifts = [2.0 * math.pi * uniform_draw(seed, f, "b") for f in range(n_features)]
    return math.sqrt(2.0 * gamma) * np.array(normal), np.array(shifts)


def ocsvm_rff(
    train: DataFrame, test: DataFrame, columns: Sequence[str], n_features: int = 64, seed=42
) -> DataFrame:
    """Add ``score``: minus the mean kernel similarity to the train rows (gamma = 1/d).

    The train table enters through the mean of its random features: every Arrow batch
    gives one partial sum, and the sums (D numbers) are added up on Spark.
    """
    columns = list(columns)
    directions, shifts = fourier_weights(len(columns), n_features, 1.0 / len(columns), seed)
    scale = math.sqrt(2.0 / n_features)

    def features(parts: Sequence[pd.Series]) -> np.ndarray:
        x = np.column_stack([p.to_numpy(float) for p in parts])
        return scale * np.cos(x @ directions + shifts)

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"n": [len(pdf)], "z": [features([pdf[c] for c in columns]).sum(0)]})

    sums = train.select(*columns).mapInPandas(partial_sums, "n long, z array<double>")
    total = sums.agg(F.sum("n").alias("n"), *[F.sum(F.get("z", F.lit(i))).alias(f"z{i}") for i in range(n_features)]).first()
    mean = np.array([total[f"z{i}"] for i in range(n_features)]) / total["n"]

    @F.pandas_udf("double")
    def similarity(*parts: pd.Series) -> pd.Series:
        return pd.Series(features(parts) @ mean)

    return test.withColumn("score", -similarity(*columns))
