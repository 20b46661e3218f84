"""Encoders and scalers: fit to a small table, apply to every split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordering import join_same, running_totals
from tidemark.sources.staging import stage


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name="feature", value="value") -> DataFrame:
    """(keys..., feature, value): one row per listed column."""
    return df.select(*keys, *columns).unpivot(list(keys), list(columns), name, value)


def category_dict(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, category, idx): the sorted distinct categories of each column."""
    seen = long_form(df, [], columns, value="category").distinct().filter("category IS NOT NULL")
    placed = running_totals(seen.withColumn("one", F.lit(1)), ["feature"], "category", ["one"])
    return stage(placed.select("feature", "category", (F.col("cum_one") - 1).alias("idx")), "categories")


def one_hot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """Sparse indicators (keys..., feature, idx); an unknown category has no row."""
    cells = long_form(df, keys, columns, value="category")
    return cells.join(dictionary, ["feature", "category"]).select(*keys, "feature", "idx")


def onehot_lookup(df: DataFrame, columns: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """Add ``<column>_idx`` per column; NULL for an unknown category."""
    for column in columns:
        entries = dictionary.filter(F.col("feature") == column).select(
            F.col("category").alias(column), F.col("idx").alias(f"{column}_idx")
        )
        df = join_same(df, entries, [column], "left")
    return df


def hconcat_features(df: DataFrame, numeric: Sequence[str], columns: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """Add ``features``: sparse vector of the numerics followed by all one-hot blocks.

    Positions are known from the dictionary alone (block offset + category index), so
    no join between feature blocks is needed and nothing dense is built.
    """
    sizes = {
        r["feature"]: r["n"]
        for r in dictionary.groupBy("feature").agg(F.max("idx").alias("n")).collect()  # one row per column
    }
    encoded = onehot_lookup(df, columns, dictionary)
    entries = [F.struct(F.lit(i).alias("pos"), F.col(c).cast("double").alias("val")) for i, c in enumerate(numeric)]
    offset = len(numeric)
    for column in columns:
        position = (F.lit(offset) + F.col(f"{column}_idx")).cast("int")
        entries.append(F.struct(position.alias("pos"), F.lit(1.0).alias("val")))
        offset += int(sizes.get(column, -1)) + 1
    cells = F.filter(F.array(*entries), lambda e: e["pos"].isNotNull() & (e["val"] != 0.0))
    return encoded.withColumn("features", cells).withColumn("width", F.lit(offset)).drop(*[f"{c}_idx" for c in columns])


def std_params(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std): population standard deviation, 0 replaced by 1. A staged table, like every fit."""
    wide = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.avg(c).alias("mean"),
                    F.when(F.stddev_pop(c) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c)).alias("std"),
                )
                for c in columns
            ]
        ).alias("params")
    )
    return stage(wide.select(F.inline("params")), "std_params")


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float]
) -> DataFrame:
    """(group..., n, q0, q1, ...): exact linearly interpolated quantiles, NULLs left out.

    Equal values are counted first, so one row per distinct value is ordered, and the
    order is kept in range slices: no task ever holds a whole group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    if not group:
        counts, keys = counts.withColumn("_all", F.lit(1)), ["_all"]
    else:
        keys = list(group)
    ranked = running_totals(counts, keys, value, ["_n"])
    first, last = F.col("cum__n") - F.col("_n"), F.col("cum__n") - 1
    picks = []
    for i, q in enumerate(probabilities):
        at = (F.col("all__n") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        picks.append(F.max(F.when((first <= low) & (low <= last), F.col(value))).alias(f"_lo{i}"))
        picks.append(F.max(F.when((first <= high) & (high <= last), F.col(value))).alias(f"_hi{i}"))
    wide = ranked.groupBy(*keys).agg(F.max("all__n").alias("n"), *picks)
    out = []
    for i, q in enumerate(probabilities):
        at = (F.col("n") - 1) * F.lit(float(q))
        step = F.col(f"_hi{i}") - F.col(f"_lo{i}")
        out.append((F.col(f"_lo{i}") + step * (at - F.floor(at))).alias(f"q{i}"))
    return wide.select(*group, "n", *out)


def robust_params(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median, iqr): exact quartiles, zero range replaced by 1."""
    q = exact_quantiles(long_form(df, [], columns), ["feature"], "value", [0.25, 0.5, 0.75])
    spread = F.col("q2") - F.col("q0")
    fitted = q.select(
        "feature", F.col("q1").alias("median"), F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("iqr")
    )
    return stage(fitted, "robust_params")


def as_map(params: DataFrame, value: str) -> Column:
    """Fitted (feature -> value) as one scalar map: one entry per feature column."""
    entries = F.map_from_entries(F.collect_list(F.struct("feature", value)))
    return params.agg(entries.alias("m")).scalar()


def scale_columns(df: DataFrame, columns: Sequence[str], params: DataFrame, centre: str, spread: str) -> DataFrame:
    """``(x - centre) / spread`` for each column; the fitted numbers travel as two scalar maps."""
    centres, spreads = as_map(params, centre), as_map(params, spread)
    return df.select(
        *[
            ((F.col(c) - centres[c]) / spreads[c]).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def standardise(df, columns, params) -> DataFrame:
    return scale_columns(df, columns, params, "mean", "std")


def robust_scale(df, columns, params) -> DataFrame:
    return scale_columns(df, columns, params, "median", "iqr")


def max_abs_z(df: DataFrame, columns: Sequence[str], params: DataFrame) -> DataFrame:
    """Add ``score``: the largest absolute z-score over the numeric features of a row."""
    means, stds = as_map(params, "mean"), as_map(params, "std")
    worst = [F.abs((F.col(c) - means[c]) / stds[c]) for c in columns]
    return df.withColumn("score", F.greatest(*worst) if len(worst) > 1 else worst[0])
