"""Isolation forest grown level by level on Spark, from all train rows.

A level is one pass over the features: every row walks through the splits known so far, every Arrow batch
gives one row of counts, minima and maxima per (tree, node) it meets, and their combination gives
a split per node. Feature and threshold come from md5 of (seed, tree, node), so SQL gives the same
forest. What is shuffled and sent is bounded by the forest, not by the table: trees * 2^level.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.hashing import hash_uniform, seeded_hash
from tidemark.sources.staging import stage, unstage

EULER = 0.5772156649
TREES = 101
HEIGHT = 8  # levels grown: the published limit for samples of 256 rows
SEED = 42


def average_path(n: Column) -> Column:
    """c(n): mean path length of an unsuccessful search among n rows."""
    c = 2.0 * (F.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return F.when(n > 2, c).when(n == 2, F.lit(1.0)).otherwise(F.lit(0.0))


def drawn_trees(key: Sequence[str], trees: int, seed: int, share: float) -> Column:
    """For every tree whether it draws the row."""
    return F.array(*[hash_uniform(seeded_hash(f"{seed}|sample|{t}", *key)) < share for t in range(trees)])


class Splits:
    """The splits known so far as arrays by (tree, node), with room for nodes of ``depth`` levels."""

    def __init__(self, trees: int, depth: int, nodes: pd.DataFrame | None = None):
        self.depth = depth
        self.feature = np.full((trees, 2 ** (depth + 1)), -1, dtype=np.int64)
        self.threshold = np.zeros(self.feature.shape)
        if nodes is not None:
            split = nodes[nodes["feature"].notna()]
            at = (split["tree"].to_numpy(), split["node"].to_numpy())
            self.feature[at], self.threshold[at] = split["feature"], split["threshold"]

    def walk(self, x: np.ndarray, tree: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """(node reached, is it open still) after so many steps; a row stays where a node is not split."""
        rows, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        open_ = np.ones(len(x), dtype=bool)
        for _ in range(steps):
            f = self.feature[tree, node]
            open_ = f >= 0
            right = x[rows, np.maximum(f, 0)] >= self.threshold[tree, node]
            node = np.where(open_, 2 * node + right, node)
        return node, open_


def _ends(rows: DataFrame, width: int, splits: Splits, trees: int) -> DataFrame:
    """(tree, node, size, lo0, hi0, lo1, ...) of the nodes at the splits' depth, combined batch by batch before the shuffle."""
    sides = [f"{side}{i}" for i in range(width) for side in ("lo", "hi")]
    drawn = "_in" in rows.columns

    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, width)
            mine = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, trees) if drawn else None
            found = []
            for t in range(trees):
                node, open_ = splits.walk(x, t, splits.depth)
                use = np.flatnonzero(open_ if mine is None else open_ & mine[:, t])
                if not len(use):
                    continue
                use = use[np.argsort(node[use], kind="stable")]
                starts = np.flatnonzero(np.diff(node[use], prepend=-1))
                part = x[use]
                low, high = np.minimum.reduceat(part, starts), np.maximum.reduceat(part, starts)
                both = np.stack([low, high], axis=2).reshape(len(starts), -1)
                found.append((np.full(len(starts), t), node[use][starts], np.diff(starts, append=len(use)), *both.T))
            if found:
                columns = [np.concatenate(c) for c in zip(*found)]
                kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.float64()] * len(sides)
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], ["tree", "node", "size", *sides])

    partial = rows.mapInArrow(run, "tree int, node int, size long, " + ", ".join(f"{c} double" for c in sides))
    ends = [F.min(c).alias(c) if c.startswith("lo") else F.max(c).alias(c) for c in sides]
    return partial.groupBy("tree", "node").agg(F.sum("size").alias("size"), *ends)


def node_splits(ends: DataFrame, width: int, seed: int) -> DataFrame:
    """(tree, node, size, feature, threshold); feature null where no feature has two values.

    The feature is the md5-drawn one of those with two values, the threshold lies evenly between its
    ends. Left goes what is below the threshold; never empty, as the threshold is above the minimum.
    """
    spans = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i in range(width)])
    found = ends.withColumn("wide", F.filter(spans, lambda s: s["hi"] > s["lo"]))
    digest = seeded_hash(seed, "tree", "node")
    found = found.withColumn("pick", F.get("wide", F.floor(hash_uniform(digest, 1) * F.size("wide")).cast("int")))
    threshold = F.col("pick.lo") + hash_uniform(digest, 9) * (F.col("pick.hi") - F.col("pick.lo"))
    # rounding may give the minimum itself, which would leave the left side empty
    threshold = F.when(threshold > F.col("pick.lo"), threshold).otherwise(F.col("pick.hi"))
    return found.select("tree", "node", "size", F.col("pick.f").alias("feature"), threshold.alias("threshold"))


class Forest:
    """Saved nodes (tree, node, size, depth, feature, threshold, path); children of node i are 2i and 2i + 1."""

    def __init__(self, nodes: DataFrame, columns: Sequence[str]):
        self.nodes, self.columns = nodes, list(columns)

    def score(self, test: DataFrame) -> DataFrame:
        """Add ``score`` = 2^(-mean path / mean c(rows of a tree)); null where a feature is null.

        The nodes that reach the driver and the tasks are at most trees * 2^(height + 1), whatever the tables.
        """
        normal = self.nodes.filter("node = 1").agg(F.avg(average_path(F.col("size").cast("double")))).first()[0]
        nodes = self.nodes.select("tree", "node", "feature", "threshold", "path").toPandas()
        depth = int(nodes["node"].max()).bit_length() - 1
        splits = Splits(int(nodes["tree"].max()) + 1, depth, nodes)
        path = np.zeros(splits.feature.shape)
        path[nodes["tree"], nodes["node"]] = nodes["path"].fillna(0.0)
        grown = sorted(set(nodes["tree"]))  # a tree that drew no row has no node

        @F.pandas_udf("double")
        def scored(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for each in parts:
                x = np.column_stack([p.to_numpy(float, na_value=np.nan) for p in each])
                total = sum(path[t, splits.walk(x, t, depth)[0]] for t in grown)
                score = np.power(2.0, -total / len(grown) / max(normal, 1e-12))
                yield pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, score))

        found = test.withColumn("score", scored(*[F.col(c).cast("double") for c in self.columns]))
        return found.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def fit_forest(
    train: DataFrame, columns: Sequence[str], trees: int = TREES, height: int = HEIGHT, seed: int = SEED,
    share: float | None = None, key: Sequence[str] = (),
) -> Forest:
    """Grow ``trees`` trees to ``height`` levels from all rows of ``train``, or from a ``share`` of them drawn per tree by ``key``.

    Rows with a null feature are left out. Raises without rows.
    """
    if share is not None and not key:
        raise ValueError("a share is drawn by a key")
    columns = list(columns)
    drawn = [] if share is None else [drawn_trees(key, trees, seed, share).alias("_in")]
    rows = train.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"), *drawn)
    rows = stage(rows.filter(~F.exists("_x", lambda v: v.isNull() | F.isnan(v))), "forest_rows")
    if rows.isEmpty():
        raise ValueError("no train rows")
    levels, known = [], None
    for depth in range(height + 1):
        found = node_splits(_ends(rows, len(columns), Splits(trees, depth, known), trees), len(columns), seed)
        if depth == height:
            found = found.withColumn("feature", F.lit(None).cast("int")).withColumn("threshold", F.lit(None).cast("double"))
        path = F.when(F.col("feature").isNull(), F.lit(float(depth)) + average_path(F.col("size").cast("double")))
        found = stage(found.withColumn("depth", F.lit(depth)).withColumn("path", path), "forest_level")
        levels.append(found)
        made = found.filter("feature IS NOT NULL").select("tree", "node", "feature", "threshold").toPandas()
        if not len(made):
            break
        known = made if known is None else pd.concat([known, made])
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    nodes = stage(nodes, "forest")
    unstage(rows, *levels)
    return Forest(nodes, columns)


def isolation_forest(train: DataFrame, test: DataFrame, columns: Sequence[str], trees: int = TREES, height: int = HEIGHT, seed: int = SEED, **sample) -> DataFrame:
    return fit_forest(train, columns, trees, height, seed, **sample).score(test)
