"""One-class score over numbers and one-hot categories together, without a dense block.

The score is that of ``centre.ocsvm_rff``: minus the mean similarity to the train rows under exp(-gamma |x-y|^2),
by random features. A one-hot block adds, to each projection, the weight of the one category a row
has. That weight is md5 of (seed, feature number, column, category), so it is computed where the row is: there is no matrix as
wide as the dictionary, and the dictionary, which tells known categories from unknown ones, is looked up by its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.centre import normal_draw, uniform_draw
from tidemark.operators.encoding import category_dict, onehot_lookup, robust_params, robust_scale
from tidemark.sources.staging import stage

CACHED = 20_000  # categories whose weights a task keeps


class CategoryWeights:
    """Weights of the categories a task meets: one row of D numbers each, kept up to CACHED."""

    def __init__(self, n_features: int, seed):
        self.n_features, self.seed, self.known = n_features, seed, {}

    def rows(self, column: str, categories: Sequence[str]) -> np.ndarray:
        if len(self.known) > CACHED:
            self.known.clear()
        found = []
        for category in categories:
            key = (column, category)
            if key not in self.known:
                self.known[key] = np.array([normal_draw(self.seed, f, column, category) for f in range(self.n_features)])
            found.append(self.known[key])
        return np.array(found).reshape(len(found), self.n_features)


def random_features(pdf: pd.DataFrame, numeric: Sequence[str], categorical: Sequence[str], width: int, weights: CategoryWeights) -> np.ndarray:
    """(rows, D) features; a null category adds nothing, as a row of zeros in its one-hot block would."""
    n, seed = weights.n_features, weights.seed
    inner = np.zeros((len(pdf), n))
    if numeric:
        directions = np.array([[normal_draw(seed, f, c) for f in range(n)] for c in numeric])
        inner += pdf[list(numeric)].to_numpy(dtype=float, na_value=np.nan) @ directions
    for c in categorical:
        codes, found = pd.factorize(pdf[c])  # null: -1
        table = np.vstack([weights.rows(c, list(found)), np.zeros((1, n))])
        inner += table[codes]
    shifts = 2.0 * math.pi * np.array([uniform_draw(seed, f, "b") for f in range(n)])
    return math.sqrt(2.0 / n) * np.cos(math.sqrt(2.0 / width) * inner + shifts)  # gamma = 1 / width


class SparseKernel:
    """Fitted tables: robust scale of the numbers, dictionary of the categories, mean random feature of the train rows (D numbers).

    Train rows with a null number take no part; a null or unknown category is a block of zeros.
    Raises if no train row is left.
    """

    def __init__(self, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], n_features: int = 64, seed=42):
        self.numeric, self.categorical, self.seed = list(numeric), list(categorical), seed
        train = train.select(*self.numeric, *self.categorical).dropna(subset=self.numeric)
        self.params = robust_params(train, self.numeric)
        self.dictionary = category_dict(train.select(*[F.col(c).cast("string").alias(c) for c in self.categorical]), self.categorical)
        self.width = len(self.numeric) + self.dictionary.count()
        ready, names, cats, width = self._ready(train), self.numeric, self.categorical, self.width

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            weights = CategoryWeights(n_features, seed)
            for pdf in batches:
                if len(pdf):
                    z = random_features(pdf, names, cats, width, weights).sum(0)
                    yield pd.DataFrame({"f": np.arange(n_features), "z": z, "n": len(pdf)})

        partial = ready.mapInPandas(sums, "f int, z double, n long")
        mean = stage(partial.groupBy("f").agg((F.sum("z") / F.sum("n")).alias("mean")), "kernel_mean")
        self.mean = stage(mean.withColumn("width", F.lit(self.width)), "kernel")
        if self.mean.isEmpty():
            raise ValueError("no train rows")

    def tables(self) -> dict[str, DataFrame]:
        return {"params": self.params, "dictionary": self.dictionary, "mean": self.mean}

    @classmethod
    def of(cls, tables: dict[str, DataFrame], numeric: Sequence[str], categorical: Sequence[str], seed=42) -> SparseKernel:
        """A model fitted before, from its ``tables``."""
        model = cls.__new__(cls)
        model.numeric, model.categorical, model.seed = list(numeric), list(categorical), seed
        model.params, model.dictionary, model.mean = tables["params"], tables["dictionary"], tables["mean"]
        model.width = model.mean.first()["width"]
        return model

    def _ready(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """The model's columns, stored under ``prefix``: numbers scaled, categories as text, null where unknown."""
        named = F.concat(F.lit(prefix), F.col("feature")).alias("feature")
        numbers, texts = [prefix + c for c in self.numeric], [prefix + c for c in self.categorical]
        scaled = robust_scale(df, numbers, self.params.select(named, "median", "iqr"))
        scaled = scaled.select(*[F.col(c).cast("string").alias(c) if c in texts else F.col(c) for c in df.columns])
        found = onehot_lookup(scaled, texts, self.dictionary.select(named, "category", "idx"))
        for c in texts:
            found = found.withColumn(c, F.when(F.col(f"{c}_idx").isNotNull(), F.col(c)))
        return found.drop(*[f"{c}_idx" for c in texts])

    def score(self, test: DataFrame) -> DataFrame:
        """Add ``score``; null where a number is null."""
        names, cats, width, seed = self.numeric, self.categorical, self.width, self.seed
        mean = np.array([r["mean"] for r in self.mean.orderBy("f").collect()])  # D numbers

        @F.pandas_udf("double")
        def similarity(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            weights = CategoryWeights(len(mean), seed)
            for each in parts:
                pdf = pd.concat(each, axis=1, keys=names + cats)
                yield pd.Series(-(random_features(pdf, names, cats, width, weights) @ mean))

        # the row's own columns go along untouched, the model's input stands beside them
        inputs = [f"_in_{c}" for c in names + cats]
        beside = test.select("*", *[F.col(c).alias(i) for c, i in zip(names + cats, inputs)])
        scored = self._ready(beside, "_in_").withColumn("score", similarity(*inputs))
        return scored.withColumn("score", F.when(~F.isnan("score"), F.col("score"))).select(*test.columns, "score")
