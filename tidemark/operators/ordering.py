"""Order-based building blocks that stay distributed when one group is huge.

A window over a whole group sorts that group in one task. These operators reach
the same exact results by range slices (``running_totals``) or by counting hash
prefixes (``hash_cut``), so a group with a third of all rows is still spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.sources.staging import stage, unstage

PREFIX = 4  # hex digits, or 2 bytes, counted in one step: at most 65,536 counts per group
SMALL = 100_000  # rows under one prefix that are counted hash by hash
MAX_PREFIX = 32  # digits of a digest
SLICE_ROWS = 500_000  # rows that one task sorts by their hash


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named keys where NULL equals NULL; keys come from ``left``."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    matched = condition[0]
    for c in condition[1:]:
        matched = matched & c
    return left.join(renamed, matched, how).drop(*[f"__{k}" for k in keys])


def running_totals(
    df: DataFrame, group: Sequence[str], order: str, sums: Sequence[str], descending: bool = False
) -> DataFrame:
    """Running and grand totals of ``sums`` per group, in the order of one column.

    ``df`` must hold one row per (group, order). Adds ``cum_<c>`` (inclusive) and
    ``all_<c>``. Rows are range-partitioned into slices and written once; slice
    totals (slices + groups rows) give each slice its offset.
    """
    # no fixed number: adaptive execution may merge neighbouring slices, which keeps their order
    cut = df.repartitionByRange(*[F.col(g) for g in group], F.col(order))
    cut = stage(cut.withColumn("_slice", F.spark_partition_id()), "slices")

    def direction(name):
        return F.desc(name) if descending else F.asc(name)

    keys = [*group, "_slice"]
    totals = cut.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = W.partitionBy(*group).orderBy(direction("_slice")).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(W.partitionBy(*group)).alias(f"all_{c}") for c in sums],
    )
    inside = W.partitionBy(*keys).orderBy(direction(order)).rowsBetween(W.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(c).over(inside).alias(f"_l_{c}") for c in sums])
    out = join_same(local, stage(offsets, "offsets"), keys)
    return out.select(
        *df.columns,
        *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"cum_{c}") for c in sums],
        *[f"all_{c}" for c in sums],
    )


def hash_cut(
    df: DataFrame,
    group: Sequence[str],
    quota: Column,
    order: Column,
    copy: Column | None = None,
    totals_by: Sequence[str] | None = None,
) -> DataFrame:
    """Per group, the hash value below which exactly ``quota`` rows lie.

    ``quota`` may use ``n`` (rows of the group) and ``n_total`` (rows of the
    coarser ``totals_by`` grouping). Counting passes over ever longer hash prefixes, then over the
    hashes inside the one prefix where the quota falls. Where the quota ends among
    copies (equal hashes), ``copy`` - a distinct id per row - decides in the same way.
    ``order`` is a digest in lower-case hex digits. Returns (group..., n, quota, cut, copy_cut); raises if a quota exceeds its group.
    """
    group = list(group)
    # the digests' bytes, written once: the counting passes never compute ``df`` again
    rows = stage(df.select(*group, _digest_bytes(order).alias("_h")), "hashes")
    cut = _prefix_cut(rows, group, "_h", quota, totals_by if totals_by is not None else group)
    short = cut.filter(F.col("quota") > F.col("n")).select(*group, "n", "quota").limit(20).collect()
    if short:
        raise ValueError(f"quota larger than the rows available: {[r.asDict() for r in short]}")
    split = cut.filter(F.col("need") < F.col("copies")).select(*group, "need", F.col("cut").alias("_h"))
    if not split.isEmpty():
        copies = df.select(*group, _digest_bytes(order).alias("_h"), (copy if copy is not None else F.lit("")).alias("_c"))
        tied = stage(join_same(copies, split, [*group, "_h"]).select(*group, "_c", "need"), "tied")
        inner = _prefix_cut(tied, group, "_c", F.col("need"), group, carry="need")
        if not inner.filter("need < copies").isEmpty():
            raise ValueError("the quota ends among rows with equal keys: give a copy id that tells them apart")
        cut = join_same(cut, inner.select(*group, F.col("cut").alias("copy_cut")), group, "left")
    else:
        cut = cut.withColumn("copy_cut", F.lit(None).cast("string"))
    unstage(rows)
    return cut.select(*group, "n", "quota", F.lower(F.hex("cut")).alias("cut"), "copy_cut")


def _digest_bytes(digest: Column) -> Column:
    """The bytes of a digest, in the same order as its digits."""
    found = F.unhex(digest)
    return F.when(F.lower(F.hex(found)) == digest, found).when(
        digest.isNotNull(), F.raise_error(F.concat(F.lit("not a digest in lower-case hex digits: "), digest)).cast("binary")
    )


def _prefix_cut(rows, group, digest, quota, totals_by, carry=None):
    per = 2 if dict(rows.dtypes)[digest] == "binary" else 1  # digits in one place of the digest
    step, longest = PREFIX // per, MAX_PREFIX // per
    extra = [F.max(carry).alias(carry)] if carry else []
    counts = rows.groupBy(*group, F.substring(digest, 1, step).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), *extra
    )
    ordered = W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.select(
        "*",
        F.sum("_n").over(ordered).alias("_cum"),
        F.sum("_n").over(W.partitionBy(*group)).alias("n"),
        F.sum("_n").over(W.partitionBy(*totals_by)).alias("n_total"),
    ).withColumn("quota", quota.cast("long"))
    reached = (F.col("_cum") >= F.col("quota")) & (F.col("_cum") - F.col("_n") < F.col("quota"))
    beyond = (F.col("quota") > F.col("n")) & (F.col("_cum") == F.col("n"))
    edge = counts.filter(reached | beyond).select(
        *group, "_p", "n", "quota", (F.col("quota") - F.col("_cum") + F.col("_n")).alias("_need"), "_n"
    )
    edge, length = stage(edge, "prefix"), step
    # the digits of the prefix grow until what is left under it is small, whatever the size of the group
    while length < longest and not edge.filter(F.col("_n") > SMALL).isEmpty():
        near = rows.withColumn("_p", F.substring(digest, 1, length))
        near = join_same(near, edge.drop("_n"), [*group, "_p"])
        length += step
        deeper = near.groupBy(*group, "n", "quota", "_need", F.substring(digest, 1, length).alias("_p")).agg(
            F.count(F.lit(1)).alias("_n")
        )
        ordered = W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
        whole = W.partitionBy(*group)
        deeper = deeper.select("*", F.sum("_n").over(ordered).alias("_cum"), F.sum("_n").over(whole).alias("_all"))
        before = F.col("_cum") - F.col("_n")
        here = (F.col("_cum") >= F.col("_need")) & (before < F.col("_need"))
        last = (F.col("_need") > F.col("_all")) & (F.col("_cum") == F.col("_all"))
        edge = deeper.filter(here | last).select(*group, "_p", "n", "quota", (F.col("_need") - before).alias("_need"), "_n")
        edge = stage(edge, "prefix")
    near = rows.withColumn("_p", F.substring(digest, 1, length)).select(*group, "_p", digest)
    near = join_same(near, edge.drop("_n"), [*group, "_p"]).groupBy(*group, "n", "quota", "_need", digest).agg(
        F.count(F.lit(1)).alias("copies")
    )
    ordered = W.partitionBy(*group).orderBy(digest).rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("_cum", F.sum("copies").over(ordered))
    before = F.col("_cum") - F.col("copies")
    found = near.filter(
        ((F.col("_cum") >= F.col("_need")) & (before < F.col("_need"))) | (F.col("quota") > F.col("n"))
    )
    return stage(
        found.select(
            *group, "n", "quota", F.col(digest).alias("cut"), (F.col("_need") - before).alias("need"), "copies"
        ),
        "cut",
    )


def mark_lowest(
    df: DataFrame,
    group: Sequence[str],
    quota: Column,
    order: Column,
    copy: Column | None = None,
    totals_by: Sequence[str] | None = None,
    name: str = "picked",
) -> DataFrame:
    """Add a boolean: is the row among the ``quota`` lowest hashes of its group?"""
    group = list(group)
    hashed = df.withColumn("_h", order).withColumn("_c", copy if copy is not None else F.lit(""))
    if group:
        cuts = hash_cut(df, group, quota, order, copy, totals_by).select(*group, "cut", "copy_cut")
        hashed = join_same(hashed, cuts, group, "left")
    else:  # one group: its single cut is a scalar, not a join
        cuts = hash_cut(df.withColumn("_all", F.lit(1)), ["_all"], quota, order, copy)
        hashed = hashed.withColumn("_cut", cuts.select(F.struct("cut", "copy_cut")).scalar())
        hashed = hashed.select("*", "_cut.cut", "_cut.copy_cut").drop("_cut")
    below = (F.col("_h") < F.col("cut")) | (
        (F.col("_h") == F.col("cut")) & (F.col("copy_cut").isNull() | (F.col("_c") <= F.col("copy_cut")))
    )
    return hashed.withColumn(name, F.coalesce(below, F.lit(False))).drop("_h", "_c", "cut", "copy_cut")


def keep_lowest(df, group, quota, order, copy=None, totals_by=None) -> DataFrame:
    """Keep exactly ``quota`` rows per group: those with the lowest hashes."""
    marked = mark_lowest(df, group, quota, order, copy, totals_by, name="_picked")
    return marked.filter("_picked").drop("_picked")


def hash_positions(
    df: DataFrame, group: Sequence[str], order: Column, copy: Column | None = None, name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row of its group in hash order; ties by ``copy``.

    Each row moves once, into sorted slices of bounded size that are written with the place of the row in its slice. Counts
    per slice and group then turn places into positions. The sort keys are computed where they are compared and do not move.
    """
    group = list(group)
    keys = [order] if copy is None else [F.when(copy.isNotNull(), order), copy]  # rows without a copy id come first
    slices = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SLICE_ROWS))
    dealt = df.repartitionByRange(slices, *group, *keys).sortWithinPartitions(*group, *keys)
    placed = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed")
    slice_ = F.shiftright("_at", 33).alias("_slice")  # the partition, above the place in it
    counts = placed.groupBy(*group, slice_).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*group, "_slice", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    placed = join_same(placed.withColumn("_slice", slice_), stage(counts, "offsets"), [*group, "_slice"])
    return placed.select(*df.columns, (F.col("_at") + F.col("_offset")).alias(name))
