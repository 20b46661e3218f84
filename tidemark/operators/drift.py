"""Drift between years: category divergence and year-on-year changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.bins import N_EDGES, log_bin_index, log_edges
from tidemark.operators.encoding import long_form
from tidemark.sources.staging import stage


def category_histograms(df: DataFrame, columns: Sequence[str], time: str = "year") -> DataFrame:
    cells = long_form(df, [time], columns, value="category")
    return cells.groupBy("feature", time, "category").agg(F.count(F.lit(1)).alias("n"))


def jeffreys_divergence(df: DataFrame, columns: Sequence[str], time: str = "year") -> DataFrame:
    """(feature, time, previous, divergence) between neighbouring times.

    Add-one smoothing over the union of the categories of the two times. Only the
    histograms are joined, never rows.
    """
    return histogram_divergence(category_histograms(df, columns, time), time)


def histogram_divergence(histograms: DataFrame, time: str = "year") -> DataFrame:
    """``jeffreys_divergence`` of histograms (feature, time, category, n); a null category is one of its own."""
    hist = stage(histograms.select("feature", time, "category", "n"), "hist")
    steps = hist.select("feature", time).distinct()
    steps = steps.withColumn("previous", F.lag(time).over(W.partitionBy("feature").orderBy(time)))
    steps = stage(steps.filter("previous IS NOT NULL"), "steps")
    now = steps.join(hist, ["feature", time]).select("feature", time, "previous", "category", F.col("n").alias("a"))
    old = steps.join(hist.withColumnRenamed(time, "previous"), ["feature", "previous"])
    old = old.select("feature", time, "previous", "category", F.col("n").alias("b"))
    both = now.select("*", F.lit(0).cast("long").alias("b")).unionByName(old.select("*", F.lit(0).cast("long").alias("a")))
    keys = ["feature", time, "previous"]
    cells = both.groupBy(*keys, "category").agg((F.sum("a") + 1).alias("a"), (F.sum("b") + 1).alias("b"))
    sums = cells.groupBy(*keys).agg(
        F.sum("a").alias("sa"), F.sum("b").alias("sb"),
    )
    p, q = F.col("a") / F.col("sa"), F.col("b") / F.col("sb")
    return cells.join(sums, keys).groupBy(*keys).agg(F.sum((p - q) * F.log(p / q)).alias("divergence"))


def sketch_bin(x: Column, scale: float) -> Column:
    """Signed bin of a number: 1 to 233 by the logarithmic edges of ``abs(x) * scale``, negative for numbers below zero.

    Bins grow with the number, so above 1 / ``scale`` an edge is within a tenth of every number in its bin. Numbers
    beyond the last edge are in the last bin; null and nan have none.
    """
    bin_ = F.coalesce(log_bin_index(F.abs(x) * F.lit(float(scale))), F.lit(N_EDGES - 1)) + 1
    return F.when(F.isnan(x) | x.isNull(), F.lit(None)).when(x < 0, -bin_).otherwise(bin_).cast("int")


def numeric_sketch(df: DataFrame, columns: Sequence[str], time: str = "year", scale: float = 1000.0) -> DataFrame:
    """(feature, time, bin, n): at most 467 counts per feature and time, combined in every task before the shuffle."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), sketch_bin(F.col(c).cast("double"), scale).alias("bin")) for c in columns]
    )
    each = df.select(time, F.explode(cells).alias("cell")).select("cell.feature", time, "cell.bin")
    return each.groupBy("feature", time, "bin").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: Sequence[DataFrame], time: str = "year") -> DataFrame:
    """The sketch of all rows, from sketches of parts of them (of other days, files or runs) with the same scale."""
    every = sketches[0]
    for sketch in sketches[1:]:
        every = every.unionByName(sketch)
    return every.groupBy("feature", time, "bin").agg(F.sum("n").alias("n"))


def numeric_divergence(sketch: DataFrame, time: str = "year") -> DataFrame:
    """(feature, time, previous, divergence) of numeric features between neighbouring times, from their sketch alone."""
    return histogram_divergence(sketch.withColumnRenamed("bin", "category"), time)


def sketch_quantiles(sketch: DataFrame, shares: Sequence[float], time: str = "year", scale: float = 1000.0) -> DataFrame:
    """(feature, time, share, value): the outer edge of the bin in which each quantile lies; null and nan do not count.

    The quantile at ``share`` is the least number with at least that share of the numbers up to it. Windows hold one
    feature's bins of one time, never rows.
    """
    whole = W.partitionBy("feature", time)
    bins = sketch.filter("bin IS NOT NULL")
    bins = bins.withColumn("total", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(whole.orderBy("bin")))
    bins = bins.withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares])))
    found = bins.filter(F.col("upto") >= F.col("share") * F.col("total")).groupBy("feature", time, "share").agg(F.min("bin").alias("bin"))
    edges = F.expr("array(" + ",".join(f"{e!r}D" for e in log_edges()) + ")")
    outer = F.get(edges, F.least(F.abs("bin"), F.lit(N_EDGES - 1))) / F.lit(float(scale))
    return found.select("feature", time, "share", (F.signum("bin") * outer).alias("value"))


def drift_lag(metrics: DataFrame, by: Sequence[str], time: str = "year", value: str = "value") -> DataFrame:
    """Change of a per-year metric against the year before."""
    ordered = W.partitionBy(*by).orderBy(time)
    return metrics.withColumn("change", F.col(value) - F.lag(value).over(ordered))


def best_so_far(metrics: DataFrame, by: Sequence[str], step: str, value: str = "value", lowest: bool = True) -> DataFrame:
    """Running best of a metric over steps (epochs or years)."""
    ordered = W.partitionBy(*by).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    best = F.min(value) if lowest else F.max(value)
    return metrics.withColumn("best", best.over(ordered))
