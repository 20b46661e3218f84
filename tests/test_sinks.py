"""Sinks that run again, and reconstruction from principal axes."""

import numpy as np
import pytest

from tidemark.operators import centre
from tidemark.sources import sinks


@pytest.mark.parametrize("sink", [sinks.sink_metrics, sinks.sink_scores])
def test_a_repeated_run_replaces_itself(spark, tmp_path, sink):
    path = str(tmp_path / "out")
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, value double")
    new = spark.createDataFrame([("a", 3.0)], "name string, value double")
    for df, run in ((old, "x"), (old, "y"), (old, "x"), (new, "x")):
        sink(df, path, run)
    got = spark.read.schema("name string, value double, run string").json(path).collect()
    assert sorted(map(tuple, got)) == [("a", 1.0, "y"), ("a", 3.0, "x"), ("b", 2.0, "y")]


def test_axes_span_what_the_svd_spans():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) @ rng.normal(size=(8, 8))
    matrix = x.T @ x / len(x)
    axes = centre.principal_axes(matrix, 3)
    _, vectors = np.linalg.eigh(matrix)
    assert np.allclose(axes @ axes.T, vectors[:, -3:] @ vectors[:, -3:].T, atol=1e-8)
    assert np.allclose(axes.T @ axes, np.eye(3))


def test_moments_of_batches_and_null_vectors(spark, partitions):
    partitions(3)
    x = np.random.default_rng(4).normal(size=(500, 5)) + 2
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(-1, None)], "id long, v array<double>").repartition(7)
    n, sums, products = centre.moments(df, "v", 5)
    assert n == 500 and np.allclose(sums, x.sum(0)) and np.allclose(products, x.T @ x)
    scored = {r["id"]: r["score"] for r in centre.pca_reconstruction(df, df, "v", 5).collect()}
    assert scored[-1] is None
    assert max(v for k, v in scored.items() if k >= 0) < 1e-9  # all axes: nothing is lost
