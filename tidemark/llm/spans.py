"""Positions of regular-expression matches, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import prefix_sums

CONTEXT = 64  # code points kept on either side of a match


def add_spans(df: DataFrame, text: str, pattern: str, name: str, likely: Column | None = None) -> DataFrame:
    """Add ``name``: array of (start, end, value, before, after) of all leftmost non-overlapping matches.

    Positions count code points, end exclusive. The texts between the matches give the positions, so
    the text is scanned twice at most, and once if nothing matches. ``before`` and ``after`` reach no further
    than the neighbouring matches. ``likely``: a cheap test that is true wherever something matches.
    """
    matches, gaps, ends = f"{name}_m", f"{name}_g", f"{name}_e"
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    if likely is not None:
        found = F.when(likely, found).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(matches, found)
    df = df.withColumn(gaps, F.when(F.size(matches) > 0, F.split(F.col(text), pattern, -1)))
    steps = F.transform(F.col(matches), lambda m, i: F.length(F.col(gaps)[i]) + F.length(m))
    df = df.withColumn(ends, F.when(F.size(matches) > 0, prefix_sums(steps)))
    spans = F.transform(
        F.col(matches),
        lambda m, i: F.struct(
            (F.col(ends)[i] - F.length(m)).alias("start"),
            F.col(ends)[i].alias("end"),
            m.alias("value"),
            F.right(F.col(gaps)[i], F.lit(CONTEXT)).alias("before"),
            F.left(F.col(gaps)[i + 1], F.lit(CONTEXT)).alias("after"),
        ),
    )
    return df.withColumn(name, spans).drop(matches, gaps, ends)


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans (rank, start, end, ...) by start, then rank; comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def kind_count(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")
