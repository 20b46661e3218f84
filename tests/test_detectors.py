"""Detectors by name: saved and loaded models, users' own, the sparse kernel and LOF against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detectors, sparse
from tidemark.operators.centre import normal_draw, uniform_draw

NUM, CAT = ["a", "b"], ["c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(160):
        # one category holds a third of the rows
        out.append((f"r{i:03d}", float(rng.normal()), float(rng.gamma(2.0)), "hot" if i % 3 == 0 else f"k{i % 7}", f"x y{i % 4}"))
    return spark.createDataFrame(out, "copy_id string, a double, b double, c string, d string")


def split(rows):
    return rows.filter("copy_id < 'r100'"), rows.filter("copy_id >= 'r100'")


def by_id(df):
    return {r["copy_id"]: r["score"] for r in df.collect()}


@pytest.mark.parametrize("name", detectors.names())
def test_a_loaded_model_scores_like_the_fitted_one(spark, rows, name, tmp_path):
    train, test = split(rows)
    options = {"isolation_forest": {"trees": 5, "height": 4}, "pca": {"components": 1}}.get(name, {})
    model = detectors.fit(name, train, NUM, CAT, **options)
    model.save(str(tmp_path / "m"))
    model.save(str(tmp_path / "m"))  # a second save replaces the first
    loaded = detectors.load(spark.newSession(), str(tmp_path / "m"))
    assert loaded.features == model.features
    first = by_id(model.score(test))
    again = loaded.score(test)
    assert again.columns == [*test.columns, "score"]
    again = by_id(again)
    assert len(again) == 60 and again.keys() == first.keys()
    assert all(again[k] == pytest.approx(first[k], abs=1e-9) for k in first)
    assert len({round(v, 9) for v in first.values()}) > 5
    with pytest.raises(ValueError):
        loaded.save(str(tmp_path / "m"))


def test_an_interrupted_save_does_not_load(spark, rows, tmp_path):
    model = detectors.fit("max_abs_z", rows, NUM)
    good = dict(model.tables)
    model.save(str(tmp_path / "m"))
    model.tables["zz"] = rows.select(F.raise_error(F.lit("lost")).cast("int").alias("x"))
    with pytest.raises(Exception, match="lost"):
        model.save(str(tmp_path / "m"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        detectors.load(spark, str(tmp_path / "m"))
    model.tables = good
    model.save(str(tmp_path / "m"))
    assert detectors.load(spark, str(tmp_path / "m")).score(rows).count() == 160


def test_users_add_detectors(spark, rows, tmp_path):
    def fit(train, f):
        return {"top": train.agg(F.max(f.numeric[0]).alias("top"))}

    def score(test, tables, f):
        return test.withColumn("score", F.col(f.numeric[0]) - tables["top"].scalar())

    detectors.register("over_top", fit, score, replace=True)
    try:
        with pytest.raises(ValueError):
            detectors.register("over_top", fit, score)
        train, test = split(rows)
        detectors.fit("over_top", train, ["a"]).save(str(tmp_path / "m"))
        got = by_id(detectors.load(spark, str(tmp_path / "m")).score(test))
        top = max(r["a"] for r in train.collect())
        assert all(got[r["copy_id"]] == pytest.approx(r["a"] - top) for r in test.collect())
    finally:
        del detectors._DETECTORS["over_top"]
    with pytest.raises(ValueError, match="over_top"):
        detectors.load(spark, str(tmp_path / "m"))


def test_nulls_give_null_scores_and_unknown_categories_a_score(spark, rows):
    train, _ = split(rows)
    odd = spark.createDataFrame([("n1", None, 1.0, "hot", "x y1"), ("n2", 0.0, 1.0, "new", None)], train.schema)
    for name in ("kernel", "centre", "pca", "lof", "knn_distance", "ecod"):
        got = by_id(detectors.fit(name, train.unionByName(odd.filter("a IS NULL")), NUM, CAT).score(odd))
        assert got["n1"] is None and got["n2"] is not None, name
    got = by_id(detectors.fit("count_model", train, (), CAT).score(odd))
    assert got["n2"] is None and got["n1"] is not None
    assert detectors.fit("kernel", train, NUM, CAT).score(odd.limit(0)).count() == 0


def test_sparse_kernel_equals_the_dense_one(spark, rows):
    train, test = split(rows)
    test = test.withColumn("c", F.when(F.col("copy_id") == "r101", "never seen").otherwise(F.col("c")))
    got = by_id(sparse.SparseKernel(train, NUM, CAT, n_features=16).score(test))
    a, b = train.toPandas(), test.toPandas()
    categories = [(c, v) for c in CAT for v in sorted(set(a[c]))]
    middle = a[NUM].median()
    spread = a[NUM].quantile(0.75) - a[NUM].quantile(0.25)

    def dense(pdf):
        one_hot = np.array([[float(r[c] == v) for c, v in categories] for _, r in pdf.iterrows()])
        return np.hstack([((pdf[NUM] - middle) / spread).to_numpy(), one_hot])

    parts = [(c,) for c in NUM] + categories
    width = len(parts)
    w = np.array([[normal_draw(42, f, *p) for f in range(16)] for p in parts]) * np.sqrt(2.0 / width)
    shift = np.array([2 * np.pi * uniform_draw(42, f, "b") for f in range(16)])
    z = lambda pdf: np.sqrt(2.0 / 16) * np.cos(dense(pdf) @ w + shift)
    expected = dict(zip(b["copy_id"], -(z(b) @ z(a).mean(0))))
    assert all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in expected)


def test_more_categories_than_a_task_keeps(monkeypatch, spark, rows):
    weights = sparse.CategoryWeights(4, 42)
    monkeypatch.setattr(sparse, "CACHED", 3)
    first = weights.rows("c", [f"v{i}" for i in range(10)])
    assert np.array_equal(first, weights.rows("c", [f"v{i}" for i in range(10)]))
    assert len(weights.known) <= 10 and weights.rows("c", []).shape == (0, 4)


def test_lof_on_scaled_numbers_equals_a_plain_version(spark, rows):
    train, test = split(rows)
    got = by_id(detectors.fit("lof", train, NUM, k=4).score(test))
    a, b = train.toPandas(), test.toPandas()
    middle = a[NUM].median()
    spread = a[NUM].quantile(0.75) - a[NUM].quantile(0.25)
    x, y = ((a[NUM] - middle) / spread).to_numpy(), ((b[NUM] - middle) / spread).to_numpy()
    between = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(between, np.inf)
    own = between.argsort(1)[:, :4]
    k_dist = np.take_along_axis(between, own, 1).max(1)
    lrd = 1 / (np.maximum(k_dist[own], np.take_along_axis(between, own, 1)).mean(1) + 1e-10)
    away = np.linalg.norm(y[:, None] - x[None], axis=2)
    near = away.argsort(1)[:, :4]
    mine = 1 / (np.maximum(k_dist[near], np.take_along_axis(away, near, 1)).mean(1) + 1e-10)
    expected = dict(zip(b["copy_id"], lrd[near].mean(1) / mine))
    assert all(got[k] == pytest.approx(expected[k], rel=1e-6) for k in expected)
