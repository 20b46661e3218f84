"""As-of lookups of fitted distributions, and neighbours by hashed buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import buckets, neighbours, tails


@pytest.mark.parametrize("slice_rows", [1, 3, 64])
def test_ecdf_lookup_equals_plain_counts(spark, partitions, monkeypatch, slice_rows):
    partitions(5)
    monkeypatch.setattr(tails, "SLICE", slice_rows)
    rng = np.random.default_rng(slice_rows)
    train = {"a": rng.integers(0, 40, 300).astype(float), "b": np.round(rng.normal(size=300), 1)}
    train["b"][:120] = 0.5  # a value that holds two fifths of the rows
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(*train.values())] + [(None, 1.0)], "a double, b double")
    fitted = tails.EcdfTable(tails.value_counts(df, ["a", "b"]))
    train["b"] = np.append(train["b"], 1.0)
    for asked in ([-5.0, 0.0, 0.5, 7.0, 7.5, 100.0], [0.5, None, 39.0, 2.0, 2.0]):
        test = spark.createDataFrame([(x, x) for x in asked], "a double, b double")
        got = {(r["feature"], r["value"]): (r["le"], r["ge"], r["n"]) for r in fitted.at(test, ["a", "b"]).collect()}
        want = {
            (f, x): (int((v <= x).sum()), int((v >= x).sum()), len(v)) for f, v in train.items() for x in set(asked) - {None}
        }
        assert got == want


def test_fitted_values_are_ranked_once(spark, monkeypatch):
    """A lookup orders the asked values and the slices' heads, never the fitted values."""
    df = spark.range(6400).select(F.col("id").cast("double").alias("a"))
    fitted = tails.EcdfTable(tails.value_counts(df, ["a"]))
    ranked, plain = [], tails.running_totals
    monkeypatch.setattr(tails, "running_totals", lambda d, *a, **b: ranked.append(d.count()) or plain(d, *a, **b))
    for asked in (10, 20):
        test = spark.range(asked).select((F.col("id") + 0.5).alias("a"))
        assert fitted.at(test, ["a"]).filter("le = floor(value) + 1").count() == asked
    assert ranked == [100 + 10, 100 + 20]


def vectors(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")


def clustered(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 20), dim)) * 4
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * 0.3 + 5.0


def test_buckets_find_what_the_exact_join_finds(spark):
    x = clustered(1200)
    df = vectors(spark, x)
    options = {"tables": 8, "probes": 2, "bucket_rows": 20}
    found = buckets.knn_buckets(df, df, 5, "id", "v", exclude_self=True, **options)
    exact = neighbours.knn_join(df, df, 5, "id", "v", exclude_self=True)
    assert buckets.recall(found, exact).first()["recall"] >= 0.9
    for r in found.filter("id < 50").collect():
        assert r["id"] != r["neighbour"]
        assert r["dist"] == pytest.approx(float(np.linalg.norm(x[r["id"]] - x[r["neighbour"]])))
    bits = buckets.bits_for(len(x), options["bucket_rows"])
    planes = buckets.directions(16, 8, bits)
    asked, held = (buckets.bucket_of(x - x.mean(0), planes, p) for p in (2, 0))
    met = np.zeros((len(x), len(x)), bool)
    for c in asked.T:
        for h in held.T:
            met |= c[:, None] == h[None, :]
    assert met.mean() < 0.5  # pairs compared, of all


def test_hot_buckets_are_cut_and_odd_rows_pass(spark):
    x = np.vstack([clustered(200), np.repeat(clustered(1), 300, axis=0)])
    df = vectors(spark, x).unionByName(spark.createDataFrame([(9999, None)], "id long, v array<double>"))
    small = buckets.knn_buckets(df, df, 3, "id", "v", exclude_self=True, tables=4, bits=3, block_rows=16)
    large = buckets.knn_buckets(df, df, 3, "id", "v", exclude_self=True, tables=4, bits=3, block_rows=4096)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert small.groupBy("id").count().filter("count = 3").count() == 500


def shuffled(spark) -> int:
    """Bytes of shuffle files that this session has on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_the_exact_join_does_not_write_vectors_for_each_cell_they_visit(spark):
    x = np.random.default_rng(3).normal(size=(3000, 32))
    df = vectors(spark, x)
    before = shuffled(spark)
    assert neighbours.knn_join(df, df, 3, "id", "v", exclude_self=True).count() == 9000
    assert shuffled(spark) - before < 4 * x.nbytes


ODD_VECTORS = {
    "far from zero": lambda g: g.normal(size=(90, 5)) * 1e-3 + 1e5,
    "tiny": lambda g: g.normal(size=(90, 5)) * 1e-30,
    "huge": lambda g: g.normal(size=(90, 5)) * 1e30,
    "single precision": lambda g: g.normal(size=(90, 5)).astype(np.float32).astype(float),
    "copies": lambda g: np.repeat(g.normal(size=(9, 5)), 10, axis=0),
    "spread": lambda g: g.normal(size=(90, 5)) * 10.0 ** g.integers(-6, 6, (90, 1)),
}


@pytest.mark.parametrize("kind", ODD_VECTORS)
def test_the_exact_join_on_odd_vectors(spark, kind):
    """Ids come twice, and as texts; vectors that are not finite are left out."""
    x = ODD_VECTORS[kind](np.random.default_rng(5))
    ids = [f"r{i % 70}" for i in range(len(x))]
    odd = [("nan", [float("nan")] * 5), ("inf", [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([*zip(ids, x.tolist()), *odd], "id string, v array<double>")
    near = neighbours.knn_join(df, df, 4, "id", "v", exclude_self=True, pivots=5, block_rows=32).collect()
    want = []
    for i in set(ids):
        pairs = [(float(np.sqrt(((x[a] - x[b]) ** 2).sum())), ids[b]) for a in range(90) for b in range(90) if ids[a] == i != ids[b]]
        want += [(i, n, d, r + 1) for r, (d, n) in enumerate(sorted(pairs)[:4])]
    got = sorted((r["id"], r["rank"], r["neighbour"], r["dist"]) for r in near)
    assert got == sorted((i, r, n, d) for i, n, d, r in want)


def test_the_exact_join_of_few_rows_and_none(spark):
    df = vectors(spark, np.arange(6.0).reshape(3, 2))
    assert neighbours.knn_join(df, df, 9, "id", "v").count() == 9
    assert neighbours.knn_join(df, df.filter("id < 0"), 9, "id", "v").count() == 0
    assert neighbours.knn_join(df.filter("id < 0"), df, 9, "id", "v").count() == 0
    unnamed = df.unionByName(spark.createDataFrame([(None, [0.0, 1.0])], "id long, v array<double>"))
    got = [tuple(r) for r in neighbours.knn_join(unnamed, unnamed, 1, "id", "v", exclude_self=True).collect()]
    assert sorted(got, key=str) == [(0, None, 0.0, 1), (1, None, 8**0.5, 1), (2, 1, 8**0.5, 1), (None, None, 0.0, 1)]
