"""Detection metrics per group (method, year, ...), all from one running-total pass.

Input is a scored table: group columns, ``label`` (1 anomaly, 0 inlier) and ``score``
(larger = more anomalous). Rows with equal scores are merged first, so the ordered
data has one row per distinct score, in range slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.hashing import seeded_hash
from tidemark.operators.ordering import join_same, mark_lowest, running_totals
from tidemark.operators.rows import nan_to_num
from tidemark.sources.staging import stage

METRICS = ("roc_auc", "pr_auc_outlier", "pr_auc_inlier", "max_f1_outlier", "max_f1_inlier")


def cum_confusion(scored: DataFrame, by: Sequence[str], score="score", label="label", weight=None) -> DataFrame:
    """One row per distinct score: pos, neg there; tp, fp at and above it; group totals."""
    w = F.col(weight) if weight else F.lit(1)
    points = scored.groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("neg"),
    )
    ranked = running_totals(points, list(by), score, ["pos", "neg"], descending=True)
    return ranked.select(
        *by,
        score,
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.col("all_pos").alias("n_pos"),
        F.col("all_neg").alias("n_neg"),
    )


def tie_rank(scored: DataFrame, by: Sequence[str], score="score", label="label") -> DataFrame:
    """Ascending rank per distinct score, averaged over ties."""
    curve = cum_confusion(scored, by, score, label)
    n = F.col("pos") + F.col("neg")
    below = F.col("n_pos") + F.col("n_neg") - F.col("tp") - F.col("fp")
    return curve.select(*by, score, n.alias("n"), (below + (n + 1) / 2).alias("avg_rank"))


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def pr_points(curve: DataFrame, by: Sequence[str], score="score") -> DataFrame:
    """Precision and recall at every distinct threshold, plus the anchor (recall 0, precision 1)."""
    points = curve.select(
        *by,
        score,
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
    )
    anchor = curve.groupBy(*by).agg(F.lit(None).cast("double").alias(score))
    anchor = anchor.select(*by, score, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(anchor)


def _trapezoid(tp, fp, pos, neg, total) -> Column:
    """Area under precision-recall added by one threshold, from its running counts."""
    tp0, fp0 = tp - pos, fp - neg
    before = F.coalesce(_ratio(tp0, tp0 + fp0), F.lit(1.0))
    return _ratio(pos, total) * (_ratio(tp, tp + fp) + before) / 2


def curve_metrics(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """All curve metrics in one aggregate; a group with a single class gives NULL."""
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")
    tp_in, fp_in = n_neg - fp + neg, n_pos - tp + pos  # same curve read from the low end
    both = F.nullif(F.max(n_pos.cast("double") * n_neg.cast("double")), F.lit(0.0))  # beyond a bigint at scale
    return curve.groupBy(*by).agg(
        (F.sum(neg * (tp - pos + pos / 2)) / both).alias("roc_auc"),
        F.sum(_trapezoid(tp, fp, pos, neg, n_pos)).alias("pr_auc_outlier"),
        F.sum(_trapezoid(tp_in, fp_in, neg, pos, n_neg)).alias("pr_auc_inlier"),
        F.max(F.when(n_pos > 0, 2 * tp / (tp + fp + n_pos))).alias("max_f1_outlier"),
        F.max(F.when(n_neg > 0, 2 * tp_in / (tp_in + fp_in + n_neg))).alias("max_f1_inlier"),
    )


def eval_grid(scored: DataFrame, by: Sequence[str], score="score", label="label", weight=None) -> DataFrame:
    """(by..., metric, value) for every group in one job."""
    clean = scored.withColumn(score, nan_to_num(F.col(score)))
    wide = curve_metrics(cum_confusion(clean, by, score, label, weight), by)
    return wide.unpivot(list(by), list(METRICS), "metric", "value")


def split_macro_avg(metrics: DataFrame, by=("method", "split", "metric")) -> DataFrame:
    """Mean of a metric over the years of a split."""
    return metrics.groupBy(*by).agg(F.avg("value").alias("value"), F.count("value").alias("n_years"))


def class_counts(df: DataFrame, by=("year",), label="label") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(F.col(label) == 0).alias("n_normal"), F.count_if(~F.col(label).eqNullSafe(0)).alias("n_anomaly")
    )


def prf_at_threshold(scored: DataFrame, by: Sequence[str], threshold: float, score="score", label="label") -> DataFrame:
    """Precision, recall, F1 and support of each class when ``score >= threshold`` is an anomaly."""
    flagged, actual = F.col(score) >= threshold, F.col(label) == 1
    cells = scored.groupBy(*by).agg(
        F.count_if(flagged & actual).alias("tp"),
        F.count_if(flagged & ~actual).alias("fp"),
        F.count_if(~flagged & actual).alias("fn"),
        F.count_if(~flagged & ~actual).alias("tn"),
    )

    def row(cls, hit, false, missed):
        p, r = F.coalesce(_ratio(hit, hit + false), F.lit(0.0)), F.coalesce(_ratio(hit, hit + missed), F.lit(0.0))
        return F.struct(
            F.lit(cls).alias("class"),
            p.alias("precision"),
            r.alias("recall"),
            F.coalesce(_ratio(2 * hit, 2 * hit + false + missed), F.lit(0.0)).alias("f1"),
            (hit + missed).alias("support"),
        )

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    both = F.array(row(0, tn, fn, fp), row(1, tp, fp, fn))
    return cells.select(*by, F.inline(both))


def precision_at_n(
    scored: DataFrame, by: Sequence[str], key: str, seed=0, score="score", label="label", copy=None
) -> DataFrame:
    """``tp / (tp + fp + 1e-5)`` among the N highest scores, N = anomalies of the group.

    The score where the N-th row falls comes from the running totals. Rows tied at that
    score are taken in seeded hash order, by counting, so the tie may be of any size. A group
    without anomalies has precision 0.
    """
    curve = stage(cum_confusion(scored, by, score, label), "curve")
    seen = F.col("tp") + F.col("fp")
    here = F.col("pos") + F.col("neg")
    edge = stage(
        curve.filter((seen >= F.col("n_pos")) & (seen - here < F.col("n_pos"))).select(
            *by, score, "n_pos", (F.col("tp") - F.col("pos")).alias("sure"),
            (F.col("n_pos") - seen + here).alias("open"),
        ),
        "edge",
    )
    tied = join_same(scored.select(*by, score, label, key, *([copy] if copy else [])), edge, [*by, score])
    order = seeded_hash(seed, key)
    taken = mark_lowest(tied, [*by, "open"], F.col("open"), order, F.col(copy) if copy else None, name="_in")
    hits = taken.groupBy(*by).agg(F.count_if(F.col("_in") & (F.col(label) == 1)).alias("_hits"))
    out = join_same(edge, hits, list(by), "left")
    tp = F.col("sure") + F.coalesce("_hits", F.lit(0))
    found = out.select(*by, "n_pos", tp.alias("tp"))
    none = curve.filter("n_pos = 0").select(*by, "n_pos", F.col("n_pos").alias("tp")).distinct()
    return found.unionByName(none).withColumn("precision_at_n", F.col("tp") / (F.col("n_pos") + 0.00001))


def class_mean_score(scored: DataFrame, by: Sequence[str], batch="batch", score="score", weight=None) -> DataFrame:
    """Mean over batches of the (weighted) batch mean."""
    w = F.col(weight) if weight else F.lit(1)
    per_batch = scored.groupBy(*by, batch).agg((F.sum(w * F.col(score)) / F.sum(w)).alias("_mean"))
    return per_batch.groupBy(*by).agg(F.avg("_mean").alias("mean_score"), F.count(F.lit(1)).alias("n_batches"))


def run_mean_std(runs: DataFrame, by: Sequence[str], value="value") -> DataFrame:
    """Mean and population deviation over runs, runs with value 0 left out."""
    kept = runs.filter(F.col(value) > 0)
    return kept.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n_runs"))


def max_normalise(scored: DataFrame, by: Sequence[str], score="score") -> DataFrame:
    """Divide each score by the largest score of its group."""
    tops = stage(scored.groupBy(*by).agg(F.max(score).alias("_top")), "tops")
    return join_same(scored, tops, list(by), "left").withColumn(score, F.col(score) / F.col("_top")).drop("_top")


def _within(scored: DataFrame, by: Sequence[str], order: str, n: int, descending: bool) -> DataFrame:
    """(by..., edge, open): per group the value of ``order`` at which the n-th row falls, and how many rows fit there."""
    counts = scored.groupBy(*by, order).agg(F.count(F.lit(1)).alias("here"))
    seen = running_totals(counts, list(by), order, ["here"], descending=descending)
    last = (F.col("cum_here") >= F.least("all_here", F.lit(n))) & (F.col("cum_here") - F.col("here") < n)
    edge = seen.filter(last & (F.col("cum_here") - F.col("here") < F.col("all_here")))
    return edge.select(*by, F.col(order).alias("_edge"), (F.lit(n) - F.col("cum_here") + F.col("here")).alias("_open"))


def _ends(scored: DataFrame, by: Sequence[str], n: int, key: str, score: str, descending: bool) -> DataFrame:
    """The first ``n`` rows per group by score and key, ranked.

    Running totals give the score of the n-th row, and the key of the last row that fits among those
    tied there. Only rows up to that point - about n per group - are sorted, whatever n is.
    """
    edge = stage(_within(scored, by, score, n, descending), "edge")
    marked = join_same(scored, edge, list(by))
    beyond = F.col(score) > F.col("_edge") if descending else F.col(score) < F.col("_edge")
    sure = marked.filter(beyond).select(*scored.columns)
    tied = marked.filter(F.col(score) == F.col("_edge"))
    keys = tied.groupBy(*by, "_open", key).agg(F.count(F.lit(1)).alias("here"))
    seen = running_totals(keys, [*by, "_open"], key, ["here"])
    fit = seen.filter(F.col("cum_here") - F.col("here") < F.col("_open")).groupBy(*by).agg(F.max(key).alias("_last"))
    kept = join_same(tied, stage(fit, "edge_keys"), list(by)).filter(F.col(key) <= F.col("_last")).select(*scored.columns)
    order = F.desc(score) if descending else F.asc(score)
    ranked = sure.unionByName(kept).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(order, key)))
    return ranked.filter(F.col("rank") <= n)


def top_n_scores(scored: DataFrame, by: Sequence[str], n: int, key: str, score="score") -> DataFrame:
    """The ``n`` highest scores per group, ties by key; rows without a score are left out."""
    return _ends(scored.filter(F.col(score).isNotNull()), by, n, key, score, descending=True)


def extreme_examples(scored: DataFrame, by: Sequence[str], n: int, key: str, score="score", label="label") -> DataFrame:
    """The ``n`` least and ``n`` most anomalous rows of the normal class."""
    normal = scored.filter((F.col(label) == 0) & F.col(score).isNotNull())
    lowest = _ends(normal, by, n, key, score, descending=False)
    highest = _ends(normal, by, n, key, score, descending=True)
    return lowest.withColumn("end", F.lit("lowest")).unionByName(highest.withColumn("end", F.lit("highest")))
