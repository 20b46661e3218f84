"""Row and column operators: roles, filters, de-duplication, held-out removal."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.labels import is_inlier, is_outlier
from tidemark.operators.ordering import join_same
from tidemark.spec import FeatureSpec


def project_keep(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in keep if c in df.columns])


def drop_label(df: DataFrame, label: str = "label") -> DataFrame:
    return df.drop(label)


def cast_numeric(df: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """Text to double. Strict fails the job on bad text (ANSI cast); lenient gives NULL."""
    cast = (lambda c: F.col(c).cast("double")) if strict else (lambda c: F.col(c).try_cast("double"))
    return df.select(*[cast(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def cast_all_string(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def rename_roles(df: DataFrame, spec: FeatureSpec, extra: Sequence[str] = ()) -> DataFrame:
    """Numbered text columns to ``cat_*``/``num_*``/``bonus_*``/``label``, numerics and label cast."""
    out = []
    for column, name in spec.renamed.items():
        if column not in df.columns:
            continue
        value = F.col(f"`{column}`")
        if column in spec.num:
            value = value.cast("double")
        elif column == spec.label:
            value = value.cast("int")
        out.append(value.alias(name))
    return df.select(*out, *extra)


def split_inliers_outliers(df: DataFrame, label: str, inlier=1) -> tuple[DataFrame, DataFrame]:
    return df.filter(is_inlier(F.col(label), inlier)), df.filter(is_outlier(F.col(label), inlier))


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def nan_to_num(x: Column, nan: float = 0.0) -> Column:
    """NaN and NULL -> ``nan``, infinities -> the largest finite doubles."""
    big = sys.float_info.max
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(nan))
        .when(x == float("inf"), F.lit(big))
        .when(x == float("-inf"), F.lit(-big))
        .otherwise(x)
    )


def replace_values(df: DataFrame, column: str, mapping: dict, name: str | None = None) -> DataFrame:
    """Map listed values of a column; other values stay."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return df.withColumn(name or column, F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column)))


def reindex_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in its order; missing ones become NULL."""
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def union_years(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def distinct_first(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per distinct combination of ``columns`` (only those columns are kept)."""
    return df.select(*columns).distinct() if columns else df.distinct()


def distinct_none(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Only combinations that occur exactly once: every copy of a repeated row goes."""
    columns = list(columns or df.columns)
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")


def distinct_none_in_steps(df: DataFrame, step: str, columns: Sequence[str] | None = None) -> DataFrame:
    """What is left of a running table that takes in one step (a month) after the other and each time drops every copy
    of a repeated row: the rows that remain, with the step that brought them in.

    A row met once in a step comes in, or goes if it was in; met twice or more it goes in any case. So it stays if, after
    the last step with several copies, the steps with one copy are odd in number: counts per row and step decide,
    and no step waits for another. Null values are equal to each other; rows without a step come first.
    """
    columns = [c for c in columns or df.columns if c != step]
    counts = df.groupBy(*columns, step).agg(F.count(F.lit(1)).alias("_n"))
    met = F.struct(F.col(step).alias("at"))  # a struct, so that a null step counts and comes first
    each = counts.groupBy(*columns).agg(
        F.collect_list(F.when(F.col("_n") == 1, met)).alias("_once"), F.max(F.when(F.col("_n") > 1, met)).alias("_several")
    )
    since = F.filter("_once", lambda at: F.col("_several").isNull() | (at > F.col("_several")))
    left = each.withColumn("_since", since).filter(F.size("_since") % 2 == 1)
    return left.select(*columns, F.array_max("_since")["at"].alias(step))


def held_out_rows(df: DataFrame, held_out: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose total count in (df + held_out) is one, so repeated rows of df go as well."""
    columns = list(columns or df.columns)
    return distinct_none(df.select(*columns).unionByName(held_out.select(*columns)))


def held_out_antijoin(df: DataFrame, held_out: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose row id is not held out; copies inside ``df`` stay."""
    return join_same(df, held_out.select(*keys).distinct(), list(keys), "left_anti")
