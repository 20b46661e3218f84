"""Isolation forest against a plain one that splits lists of rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forest


def unit(seed, tree, node, at):
    return int(hashlib.md5(f"{seed}|{tree}|{node}".encode()).hexdigest()[at - 1 : at + 7], 16) / 2**32


def c(n):
    return 2 * (math.log(n - 1) + forest.EULER) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def plain_path(train, row, tree, height, seed=forest.SEED):
    rows, node = train, 1
    for depth in range(height + 1):
        wide = [f for f in range(len(row)) if min(r[f] for r in rows) < max(r[f] for r in rows)]
        if depth == height or not wide:
            return depth + c(len(rows))
        f = wide[int(unit(seed, tree, node, 1) * len(wide))]
        low, high = min(r[f] for r in rows), max(r[f] for r in rows)
        cut = low + unit(seed, tree, node, 9) * (high - low)
        cut = cut if cut > low else high
        right = row[f] >= cut
        rows = [r for r in rows if (r[f] >= cut) == right]
        node = 2 * node + right


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double")


@pytest.mark.parametrize(("height", "parts"), [(3, 1), (8, 4)])
def test_scores_equal_a_plain_forest(spark, partitions, height, parts):
    partitions(parts)
    rng = np.random.default_rng(height)
    x = np.round(np.vstack([rng.normal(size=(150, 2)), [[9.0, -9.0]], rng.normal(size=(5, 2)).repeat(4, axis=0)]), 2)
    x[::3, 1] = 0.5
    train = [tuple(r) for r in x]
    df = frame(spark, x).repartition(3)
    got = {r["k"]: r["score"] for r in forest.isolation_forest(df, df, ["a", "b"], trees=7, height=height).collect()}
    for k, row in enumerate(train):
        mean = sum(plain_path(train, row, t, height) for t in range(7)) / 7
        assert got[k] == pytest.approx(2 ** (-mean / c(len(train))))
    assert max(got, key=got.get) == 150


def test_every_row_enters_every_tree(spark):
    df = spark.range(5000).select("id", (F.col("id") % 97).alias("a"), F.sqrt("id").alias("b"))
    nodes = forest.fit_forest(df, ["a", "b"], trees=5, height=4).nodes
    at_root = {r["tree"]: r["size"] for r in nodes.filter("node = 1").collect()}
    assert at_root == {t: 5000 for t in range(5)}
    ends = nodes.filter("feature IS NULL").groupBy("tree").agg(F.sum("size").alias("n")).collect()
    assert {r["n"] for r in ends} == {5000}


def test_a_drawn_share_differs_by_tree(spark):
    df = spark.range(4000).select("id", F.sin("id").alias("a"), F.cos("id").alias("b"))
    nodes = forest.fit_forest(df, ["a", "b"], trees=6, height=3, share=0.1, key=["id"]).nodes
    sizes = [r["size"] for r in nodes.filter("node = 1").collect()]
    assert len(set(sizes)) > 1 and all(300 < n < 500 for n in sizes)


def test_nulls_ties_and_equal_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)] * 6 + [(2, None, 2.0)], "k long, a double, b double")
    scored = forest.isolation_forest(df, df, ["a", "b"], trees=3, height=4).collect()
    assert [r["score"] for r in scored if r["k"] == 2] == [None]
    assert {r["score"] for r in scored if r["k"] == 1} == {0.5}  # one node: the path is c(6)
    with pytest.raises(ValueError, match="no train rows"):
        forest.fit_forest(df.filter("k = 2"), ["a", "b"])
