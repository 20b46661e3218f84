"""Mixing sources to target weights, with DataFrame functions only.

Temperature mixing: token shares of the sources are raised to an exponent and normalised. The
exponent is bisected on a fixed grid until the mix meets a target entropy or a repetition limit.
Each weight becomes a token quota, filled by seeded permutations of the source's documents: whole
epochs, then a part of one. A source's stream is laid evenly over the blocks of the mix, so every
block holds the sources by weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import column, documents, hot_lookup, packed, unpacked
from tidemark.llm.registry import query
from tidemark.sources.staging import stage

GRID = 1 << 20  # exponents are multiples of 1/GRID
SECTIONS = 32  # exponents tried per pass over the sources
SLICE_ROWS = 1000  # expected rows of one slice of a permutation
MAX_BITS = 24


def word_tokens(text: Column) -> Column:
    """Words between ASCII white space, and one for the end of the text; null counts as empty."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def source_key(source: Column) -> Column:
    """Never null: null is a source of its own."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def _curve(sources: DataFrame, total: int, budget: int, steps: list[int]) -> dict[int, tuple[float, float]]:
    """step -> (entropy, most repetitions), one aggregate over the sources for all steps."""
    share = F.col("tokens") / F.lit(float(total))
    rows = sources.select("tokens", share.alias("share"), F.explode(F.array(*map(F.lit, steps))).alias("step"))
    power = F.pow("share", F.col("step") / GRID)
    sums = rows.groupBy("step").agg(
        F.sum(power).alias("z"),
        F.sum(power * F.log(power)).alias("zl"),
        F.max(power / F.col("tokens")).alias("most"),
    )
    return {r.step: (math.log(r.z) - r.zl / r.z, r.most * budget / r.z) for r in sums.collect()}


def bisect_exponent(
    sources: DataFrame, total: int, budget: int, target_entropy: float | None = None, max_repeats: float | None = None
) -> float:
    """The exponent, a multiple of 1/GRID in [0, 1]; ``sources`` has ``tokens`` per source.

    Entropy falls and repetition falls as the exponent rises. The result is the largest exponent
    with at least the target entropy, raised if need be to the smallest one within the repetition limit.
    """

    def last_true(test) -> int:
        low, high = 0, GRID + 1  # test(low) is taken as true, test(high) as false
        while high - low > 1:
            steps = sorted({low + (high - low) * i // SECTIONS for i in range(1, SECTIONS)} - {low, high})
            curve = _curve(sources, total, budget, steps)
            for step in steps:
                if test(curve[step]):
                    low = step
                else:
                    high = step
                    break
        return min(low, GRID)

    step = GRID
    if target_entropy is not None:
        step = last_true(lambda at: at[0] >= target_entropy)
    if max_repeats is not None:
        over = lambda at: at[1] > max_repeats
        if target_entropy is None or over(_curve(sources, total, budget, [step])[step]):
            at_zero = over(_curve(sources, total, budget, [0])[0])
            step = min(last_true(over) + 1, GRID) if at_zero else 0
    return step / GRID


def source_quotas(
    rows: DataFrame,
    budget_share: float = 1.0,
    entropy_share: float | None = None,
    max_repeats: float | None = None,
) -> DataFrame:
    """(_source, rows, tokens, weight, quota) per source of ``rows`` (_source, tokens); staged.

    ``budget_share``: tokens of the mix as a share of all tokens. ``entropy_share``: target entropy as
    a share of the highest possible, the logarithm of the number of sources.
    """
    sources = stage(
        rows.groupBy("_source").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("tokens")), "sources"
    )
    seen = sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    budget = int(math.floor(seen.t * budget_share))
    exponent, z = 1.0, 1.0
    if seen.n:
        target = None if entropy_share is None else entropy_share * math.log(seen.n)
        exponent = bisect_exponent(sources, seen.t, budget, target, max_repeats)
    power = F.pow(F.col("tokens") / F.lit(float(max(seen.t, 1))), F.lit(exponent))
    if seen.n:
        z = sources.agg(F.sum(power).alias("z")).first().z
    weight = power / F.lit(z)
    return sources.select("*", weight.alias("weight"), F.floor(F.round(weight * F.lit(float(budget)), 3)).cast("long").alias("quota"))


def _order(seed: int, epoch: Column) -> Column:
    """Sort key of a row in one epoch's permutation; rows equal in id and length share a place."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "tokens"))


def permuted_stream(rows: DataFrame, quotas: DataFrame, total: int, seed: int) -> DataFrame:
    """Every epoch that a quota reaches into, each row with ``start`` and ``place``: tokens of its source's stream before and with it.

    A permutation is cut into slices by hash prefix. Rows are ordered within a slice, slices within a
    run of 1024 slices, and runs within the source, so no step orders a whole source in one task.
    """
    quotas = quotas.withColumnRenamed("tokens", "all_tokens")
    met = hot_lookup(rows, quotas, "_source", "rows", total)
    last = F.floor((F.col("quota") - 1) / F.col("all_tokens"))
    met = met.filter("quota > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    bits = F.ceil(F.log2(F.greatest(F.col("rows") / SLICE_ROWS, F.lit(1.0)))).cast("int")
    bits = F.least(bits, F.lit(MAX_BITS))
    prefix = F.conv(F.substring("order", 1, 6), 16, 10).cast("long")
    met = met.withColumn("order", _order(seed, F.col("epoch").cast("string")))
    met = met.withColumn("slice", F.floor(prefix / F.pow(F.lit(2.0), F.lit(MAX_BITS) - bits)).cast("long"))
    met = stage(met.withColumn("run", F.floor(F.col("slice") / 1024).cast("long")), "stream")

    slices = met.groupBy("_source", "epoch", "run", "slice").agg(F.sum("tokens").alias("of_slice"))
    before = W.partitionBy("_source", "epoch", "run").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("slice_at", F.coalesce(F.sum("of_slice").over(before), F.lit(0).cast("long")))
    runs = met.groupBy("_source", "epoch", "run").agg(F.sum("tokens").alias("of_run"))
    before = W.partitionBy("_source", "epoch").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("run_at", F.coalesce(F.sum("of_run").over(before), F.lit(0).cast("long")))
    offsets = slices.join(runs, ["_source", "epoch", "run"])
    offsets = stage(offsets.select("_source", "epoch", "slice", (F.col("slice_at") + F.col("run_at")).alias("at")), "offsets")

    inside = W.partitionBy("_source", "epoch", "slice").orderBy("order")  # rows with one key count together
    placed = met.withColumn("inside", F.sum("tokens").over(inside)).join(offsets, ["_source", "epoch", "slice"])
    peers = F.sum("tokens").over(W.partitionBy("_source", "epoch", "slice", "order"))
    place = F.col("epoch") * F.col("all_tokens") + F.col("at") + F.col("inside")
    placed = placed.withColumn("place", place).withColumn("start", F.col("place") - peers)
    return placed.drop("slice", "run", "at", "inside")


def _narrow(docs: DataFrame, tokens: Column, source: str) -> DataFrame:
    return docs.select(
        column("doc_id").alias("doc_id"), source_key(column(source)).alias("_source"), tokens.alias("tokens")
    )


def mix(
    docs: DataFrame,
    tokens: Column,
    source: str = "source",
    budget_share: float = 1.0,
    entropy_share: float | None = 0.95,
    max_repeats: float | None = 4.0,
    blocks: int = 64,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, source, epoch, tokens, place, block): one row for each time a document is used.

    ``place`` is the source's tokens up to and with this use. The document in which the quota ends is used whole,
    so a source is never lost to a long document and exceeds its quota by less than that one. ``tokens`` is at least 1
    per row. Null texts have one token, null is a source of its own. Rows equal in id and token count share their place
    and are used together. Extra columns are ignored; an empty table gives no rows.
    """
    rows = stage(_narrow(docs, tokens, source), "mix")
    total = rows.count()
    quotas = stage(source_quotas(rows, budget_share, entropy_share, max_repeats), "quotas")
    used = permuted_stream(rows, quotas, total, seed).filter("start < quota")
    block = F.expr(f"(start * {blocks}) div quota")
    name = F.when(F.col("_source") == "", F.lit(None)).otherwise(F.expr("substring(_source, 2)"))
    return used.select("doc_id", name.alias("source"), "epoch", "tokens", "place", block.alias("block"))


def mixed_documents(
    docs: DataFrame,
    tokens: Column,
    source: str = "source",
    budget_share: float = 1.0,
    entropy_share: float | None = None,
    max_repeats: float | None = 1.0,
    seed: int = 7,
) -> DataFrame:
    """The rows of ``docs`` that the mix uses, columns unchanged, each as often as it is used.

    The texts are not shuffled: per source, the number of whole epochs and the last key used of the
    part epoch say how often a row is used. Nulls, ties, repeated rows and empty tables as in ``mix``.
    """
    rows = stage(_narrow(docs, tokens, source), "mix")
    total = rows.count()
    quotas = stage(source_quotas(rows, budget_share, entropy_share, max_repeats), "quotas")
    whole = F.floor(F.col("quota") / F.col("tokens")).alias("whole")
    plan = quotas.select("_source", "rows", whole)
    stream = permuted_stream(rows, quotas, total, seed)
    part = stream.filter("start < quota AND epoch = floor(quota / all_tokens)")
    cuts = part.groupBy("_source").agg(F.max("order").alias("cut"))
    plan = stage(plan.join(cuts, "_source", "left"), "plan")
    keyed = docs.select(
        packed(docs).alias("_row"),
        column("doc_id").alias("doc_id"),
        source_key(column(source)).alias("_source"),
        tokens.alias("tokens"),
    )
    met = hot_lookup(keyed, plan, "_source", "rows", total)
    in_part = F.col("cut").isNotNull() & (_order(seed, F.col("whole").cast("string")) <= F.col("cut"))
    uses = F.col("whole").cast("int") + F.when(in_part, 1).otherwise(0)
    met = met.withColumn("_uses", uses).filter("_uses > 0")
    return unpacked(met.select("_row", F.explode(F.sequence(F.lit(1), F.col("_uses")))), "_row", docs.columns)


# Bisection in SQL: 21 halvings of the exponent's grid for the entropy, then for the repetition limit.
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS k,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS BIGINT) AS tokens FROM documents),
s AS (SELECT k, any_value(source) AS source, CAST(sum(tokens) AS BIGINT) AS t FROM d GROUP BY k),
a AS (SELECT list(t) AS ts, CAST(sum(t) AS DOUBLE) AS total, CAST(sum(t) AS BIGINT) AS budget,
  0.95 * ln(count(*)) AS target FROM s),
e(n, lo, hi) AS (
  SELECT 0, 0, 1048577
  UNION ALL
  SELECT n + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT n, lo, hi, mid, ln(z) - zl / z >= target AS ok FROM (
      SELECT n, lo, hi, mid, target, list_sum(ps) AS z, list_sum(list_transform(ps, lambda p: p * ln(p))) AS zl FROM (
        SELECT n, lo, hi, (lo + hi) // 2 AS mid, target,
          list_transform(ts, lambda x: pow(x / total, ((lo + hi) // 2) / 1048576.0)) AS ps
        FROM e, a WHERE n < 21 AND hi - lo > 1)))),
h AS (SELECT least(max(lo), 1048576) AS step FROM e),
r(n, lo, hi) AS (
  SELECT 0, -1, 1048576
  UNION ALL
  SELECT n + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT n, lo, hi, mid, list_max(rs) * budget / list_sum(ps) > 4.0 AS ok FROM (
      SELECT n, lo, hi, mid, budget, ps, list_transform(ps, lambda p, i: p / ts[i]) AS rs FROM (
        SELECT n, lo, hi, (lo + hi) // 2 AS mid, budget, ts,
          list_transform(ts, lambda x: pow(x / total, ((lo + hi) // 2) / 1048576.0)) AS ps
        FROM r, a WHERE n < 22 AND hi - lo > 1)))),
x AS (SELECT greatest(h.step, (SELECT min(hi) FROM r)) / 1048576.0 AS ex FROM h),
w AS (SELECT k, source, t, pow(t / total, ex) AS p, budget FROM s, a, x),
q AS (SELECT k, source, t, CAST(floor(round(p / (SELECT sum(p) FROM w) * budget, 3)) AS BIGINT) AS quota FROM w),
u AS (
  SELECT doc_id, k, epoch, tokens, t, quota, q.source AS source,
    md5('7|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || tokens) AS o
  FROM (SELECT *, unnest(range(0, CAST((quota - 1) // t AS BIGINT) + 1)) AS epoch FROM q WHERE quota > 0) q JOIN d USING (k)),
p AS (SELECT *, epoch * t + CAST(sum(tokens) OVER (PARTITION BY k, epoch ORDER BY o) AS BIGINT) AS place,
  CAST(sum(tokens) OVER (PARTITION BY k, epoch, o) AS BIGINT) AS peers FROM u)
SELECT doc_id, source, epoch, tokens, place, ((place - peers) * 64) // quota AS block FROM p WHERE place - peers < quota"""


@query("op8_mixing", MIX_SQL)
def op8_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir), word_tokens(column("text")))
