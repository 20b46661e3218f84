"""Label rules: three-way label -> binary label and the class predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# 1 inlier, -1 known anomaly, -2 unknown anomaly.
INLIER, KNOWN_ANOMALY, UNKNOWN_ANOMALY = 1, -1, -2


def recode_label(label: Column) -> Column:
    """1 -> 0 and every negative value -> 1; other values stay."""
    return F.when(label == INLIER, 0).when(label < 0, 1).otherwise(label).cast("int")


def is_inlier(label: Column, value=INLIER) -> Column:
    return label.eqNullSafe(F.lit(value))


def is_outlier(label: Column, value=INLIER) -> Column:
    """Not an inlier; a NULL label counts as an outlier."""
    return ~label.eqNullSafe(F.lit(value))


def anomaly_kind(label: Column) -> Column:
    return (
        F.when(label == INLIER, "inlier")
        .when(label == KNOWN_ANOMALY, "known")
        .when(label == UNKNOWN_ANOMALY, "unknown")
    )


def one_vs_rest(label: Column, normal) -> Column:
    """0 for the normal class, 1 for every other class."""
    return (label != F.lit(normal)).cast("int")


def class_sets(label: Column, normal: Iterable, anomaly: Iterable) -> Column:
    """0 / 1 by membership in two value lists; NULL (to be dropped) outside both."""
    return F.when(label.isin(*normal), 0).when(label.isin(*anomaly), 1).cast("int")
