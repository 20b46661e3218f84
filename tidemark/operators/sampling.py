"""Samples, splits and quotas: exact sizes, reproducible from a seed.

Rows are ordered by md5(seed|row key). ``copy`` names a column that is distinct per
row; it decides which of several equal rows is taken, so the sizes stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.hashing import seeded_hash
from tidemark.operators.ordering import hash_positions, join_same, keep_lowest, mark_lowest

HOLDOUT_SEED = 10


def _copy(copy):
    return F.col(copy) if isinstance(copy, str) and copy else copy


def half_even(share: float) -> Column:
    """Quota ``round(n * share)``, halves to even."""
    return F.bround(F.col("n") * F.lit(float(share)), 0)


def mark_holdout(
    df: DataFrame, share: float, strata: Sequence[str], seed=HOLDOUT_SEED, key="row_key", copy="copy_id"
) -> DataFrame:
    """Add ``part``: ``valid`` for ``share`` of every stratum, ``train`` for the rest."""
    marked = mark_lowest(df, strata, half_even(share), seeded_hash(seed, key), _copy(copy), name="_valid")
    return marked.withColumn("part", F.when(F.col("_valid"), "valid").otherwise("train")).drop("_valid")


def sample_fraction(df: DataFrame, share: float, seed, by=(), key="row_key", copy="copy_id") -> DataFrame:
    return keep_lowest(df, by, half_even(share), seeded_hash(seed, key), _copy(copy))


def sample_rows(df: DataFrame, n: int, seed, by=(), key="row_key", copy="copy_id") -> DataFrame:
    """Exactly ``n`` rows per group without replacement; raises if a group has fewer."""
    return keep_lowest(df, by, F.lit(n), seeded_hash(seed, key), _copy(copy))


def contaminate(
    df: DataFrame, share: float, seed, outlier="is_outlier", by=("year",), key="row_key", copy="copy_id"
) -> DataFrame:
    """Per year ``int(N*(1-share))`` clean rows and ``int(N*share)`` anomalies.

    N counts all rows of the year. Clean rows are left alone when that quota is N,
    and a quota above the rows of its class raises.
    """
    clean, dirty = F.lit(1.0 - share), F.lit(float(share))
    n_clean = F.floor(F.col("n_total") * clean)
    wanted = F.when(F.col(outlier), F.floor(F.col("n_total") * dirty)).otherwise(
        F.when(n_clean < F.col("n_total"), n_clean).otherwise(F.col("n"))
    )
    return keep_lowest(df, [*by, outlier], wanted, seeded_hash(seed, key), _copy(copy), totals_by=list(by))


def with_share(df: DataFrame, share: float, seed, outlier="is_outlier", by=("year",), key="row_key", copy="copy_id") -> DataFrame:
    """Per group the largest sample in which just over ``share`` of the rows are anomalies; its size grows with the group.

    All rows of the scarcer class stay: all clean rows with ``ceil(clean * share / (1 - share))`` anomalies, or, with fewer
    anomalies than that, all of them with ``floor(anomalies * (1 - share) / share)`` clean rows.
    """
    odds = share / (1.0 - share)
    other = F.col("n_total") - F.col("n")
    quota = F.when(F.col(outlier), F.ceil(other * F.lit(odds))).otherwise(F.floor(other / F.lit(odds)))
    return keep_lowest(df, [*by, outlier], F.least(F.col("n"), quota), seeded_hash(seed, key), _copy(copy), totals_by=list(by))


def train_val_split(df: DataFrame, share: float, seed, key="row_key", copy="copy_id") -> DataFrame:
    """Add ``part`` with ``ceil(n * share)`` validation rows."""
    quota = F.ceil(F.col("n") * F.lit(float(share)))
    marked = mark_lowest(df, [], quota, seeded_hash(seed, key), _copy(copy), name="_val")
    return marked.withColumn("part", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")


def half_inlier_split(df: DataFrame, seed, label="label", key="row_key", copy="copy_id") -> DataFrame:
    """``n // 2 + 1`` inliers train (all, if there is only one); other inliers and all anomalies test."""
    half = F.least(F.floor(F.col("n") / 2) + 1, F.col("n"))
    quota = F.when(F.col(label) == 0, half).otherwise(0)
    marked = mark_lowest(df, [label], quota, seeded_hash(seed, key), _copy(copy), name="_train")
    return marked.withColumn("part", F.when(F.col("_train"), "train").otherwise("test")).drop("_train")


def ratio_downsample(df: DataFrame, seed, ratio=4, label="label", key="row_key", copy="copy_id") -> DataFrame:
    """All inliers and ``floor(inliers / ratio)`` anomalies; raises if there are fewer."""
    inliers = F.col("n_total") - F.col("n")
    quota = F.when(F.col(label) == 1, F.floor(inliers / ratio)).otherwise(F.col("n"))
    return keep_lowest(df, [label], quota, seeded_hash(seed, key), _copy(copy), totals_by=[])


def shuffle_rows(df: DataFrame, seed, by=(), key="row_key", copy="copy_id") -> DataFrame:
    """Add the ``position`` of each row in a seeded permutation (of its group). ``copy`` may also be computed from a narrower column."""
    return hash_positions(df, list(by), seeded_hash(seed, key), _copy(copy))


def batch_numbers(
    df: DataFrame, size: int, seed, by=(), key="row_key", copy="copy_id", skip_tail: bool = False
) -> DataFrame:
    """Add ``batch`` = (position - 1) div size within the group.

    ``skip_tail`` keeps only ``max(n // size - 1, 1)`` batches: the last full batch
    and the remainder are left out.
    """
    placed = shuffle_rows(df, seed, by, key, copy)
    placed = placed.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("long"))
    if not skip_tail:
        return placed
    steps = F.greatest(F.floor(F.count(F.lit(1)) / size) - 1, F.lit(1)).alias("_steps")
    if by:
        placed = join_same(placed, df.groupBy(*by).agg(steps), list(by))
    else:
        placed = placed.withColumn("_steps", df.agg(steps).scalar())
    return placed.filter(F.col("batch") < F.col("_steps")).drop("_steps")
