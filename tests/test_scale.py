"""Hot groups, copies, skewed keys: exact results, whatever the partitioning."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import centre, metrics, neighbours, ordering, tails
from tidemark.operators.ordering import join_same, keep_lowest, running_totals
from tidemark.operators.sampling import shuffle_rows


@pytest.mark.parametrize("n", [1, 7])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, partitions, n, descending):
    partitions(n)
    rng = random.Random(3)
    data = [("hot" if i % 3 else None, float(v), rng.randint(1, 9)) for i, v in enumerate(rng.sample(range(10_000), 900))]
    df = spark.createDataFrame(data, "g string, x double, w int")
    got = {(r["g"], r["x"]): (r["cum_w"], r["all_w"]) for r in running_totals(df, ["g"], "x", ["w"], descending).collect()}
    for group in ("hot", None):
        total, mine = 0, sorted((d for d in data if d[0] == group), key=lambda d: d[1], reverse=descending)
        for g, x, w in mine:
            total += w
            assert got[(g, x)] == (total, sum(d[2] for d in mine))


@pytest.mark.parametrize("quota", [0, 1, 40, 41, 75, 120])
def test_quota_inside_a_group_of_copies(spark, quota):
    """A third of the rows are equal; the quota is met exactly wherever it ends."""
    keys = ["same"] * 40 + [f"k{i}" for i in range(80)]
    df = spark.createDataFrame([(k, f"{i:016x}") for i, k in enumerate(keys)], "k string, c string")
    spread = F.md5(F.col("c"))
    kept = keep_lowest(df, [], F.lit(quota), F.md5(F.col("k")), spread).collect()
    hashes = sorted((hashlib.md5(k.encode()).hexdigest(), hashlib.md5(f"{i:016x}".encode()).hexdigest()) for i, k in enumerate(keys))
    got = sorted((hashlib.md5(r["k"].encode()).hexdigest(), hashlib.md5(r["c"].encode()).hexdigest()) for r in kept)
    assert got == hashes[:quota]


def test_quota_among_indistinct_rows_raises(spark):
    df = spark.createDataFrame([("same",)] * 30, "k string")
    with pytest.raises(ValueError, match="equal keys"):
        keep_lowest(df, [], F.lit(7), F.md5("k"))
    assert keep_lowest(df, [], F.lit(30), F.md5("k")).count() == 30


def test_shuffle_numbers_copies_apart(spark):
    df = spark.createDataFrame([("same", f"{i:016x}") for i in range(500)], "row_key string, copy_id string")
    assert sorted(r["position"] for r in shuffle_rows(df, 1).collect()) == list(range(1, 501))


def test_a_hot_key_is_split_by_adaptive_execution(spark, tmp_path):
    """A table too large to broadcast, though it has few rows: the hot key's partition is split, nothing is lost."""
    n = 300
    wide = spark.range(n).selectExpr("id AS k", "repeat(cast(id AS string), 2000) AS v")
    wide.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    rows = spark.range(0, 60_000, 1, 8).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 100 = 1 THEN NULL ELSE id % 400 END AS k")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = join_same(rows, table, ["k"], "left").selectExpr("id", "k", "length(v) AS w")
        got = joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == 60_000
    for r in got[::97]:
        k = 7 if r["id"] % 3 == 0 else None if r["id"] % 100 == 1 else r["id"] % 400
        assert r["w"] == (None if k is None or k >= n else 2000 * len(str(k)))


def test_quota_with_long_prefixes(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL", 50)
    monkeypatch.setattr(ordering, "PREFIX", 1)
    df = spark.range(4000).selectExpr("cast(id % 3 AS string) AS g", "cast(id % 900 AS string) AS k", "lpad(hex(id), 16, '0') AS c")
    kept = keep_lowest(df, ["g"], F.lit(501), F.md5("k"), F.col("c")).collect()
    rows = [(r["g"], r["k"], r["c"]) for r in df.collect()]
    for g in "012":
        order = sorted((hashlib.md5(k.encode()).hexdigest(), c) for x, k, c in rows if x == g)[:501]
        assert sorted((hashlib.md5(r["k"].encode()).hexdigest(), r["c"]) for r in kept if r["g"] == g) == order


def test_top_n_of_any_size(spark):
    rows = [(g, f"k{i:05d}", float(i % 40)) for g in ("a", "b") for i in range(3000 if g == "a" else 7)]
    df = spark.createDataFrame(rows, "g string, key string, score double")
    for n in (1, 5, 1200, 5000):
        top = metrics.top_n_scores(df, ["g"], n, "key")
        got = sorted((r["g"], r["rank"], r["key"]) for r in top.collect())
        want = []
        for g in ("a", "b"):
            order = sorted((-s, k) for x, k, s in rows if x == g)[:n]
            want += [(g, i + 1, k) for i, (_, k) in enumerate(order)]
        assert got == sorted(want)


def test_curve_metrics_of_very_many_rows(spark):
    """Counts whose product is beyond a bigint."""
    rows = [("a", 1, 0.9, 4_000_000_000), ("a", 0, 0.9, 1_000_000_000), ("a", 0, 0.1, 4_000_000_000)]
    df = spark.createDataFrame(rows, "g string, label int, score double, w long")
    got = {r["metric"]: r["value"] for r in metrics.eval_grid(df, ["g"], weight="w").collect()}
    assert got["roc_auc"] == pytest.approx(0.9)


def test_precision_at_n_without_anomalies(spark):
    rows = [("a", "x", 0, 1.0), ("a", "y", 0, 2.0), ("b", "z", 1, 1.0), ("b", "w", 0, 0.5)]
    df = spark.createDataFrame(rows, "g string, key string, label int, score double")
    got = {r["g"]: (r["n_pos"], r["tp"], r["precision_at_n"]) for r in metrics.precision_at_n(df, ["g"], "key").collect()}
    assert got["a"] == (0, 0, 0.0)
    assert got["b"][:2] == (1, 1)


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")


def brute_knn(q, t, k, exclude_self):
    out = {}
    for i, a in enumerate(q):
        d = sorted((float(np.sqrt(((a - b) ** 2).sum())), j) for j, b in enumerate(t) if not (exclude_self and i == j))
        out[i] = d[:k]
    return out


@pytest.mark.parametrize("pivots,block_rows", [(1, 1000), (6, 25), (40, 10)])
def test_knn_is_exact(spark, pivots, block_rows):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(150, 3)), np.repeat(rng.normal(size=(1, 3)), 90, axis=0), rng.normal(size=(30, 3)) * 40])
    df = vectors(spark, x)
    near = neighbours.knn_join(df, df, 4, "id", "v", exclude_self=True, pivots=pivots, block_rows=block_rows).collect()
    got = {}
    for r in sorted(near, key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append((r["dist"], r["neighbour"]))
    for i, expected in brute_knn(x, x, 4, True).items():
        assert [j for _, j in got[i]] == [j for _, j in expected]
        assert [d for d, _ in got[i]] == pytest.approx([d for d, _ in expected], abs=1e-12)


def test_lof_against_brute_force(spark):
    rng = np.random.default_rng(1)
    t, q, k = rng.normal(size=(60, 2)), rng.normal(size=(25, 2)) * 2, 5
    own = brute_knn(t, t, k, True)
    kd = {i: d[-1][0] for i, d in own.items()}
    density = lambda near: 1 / (np.mean([max(kd[j], d) for d, j in near]) + 1e-10)
    lrd = {i: density(near) for i, near in own.items()}
    want = {i: np.mean([lrd[j] for _, j in near]) / density(near) for i, near in brute_knn(q, t, k, False).items()}
    got = neighbours.lof(vectors(spark, q), vectors(spark, t), k, "id", "v", pivots=4, block_rows=16).collect()
    assert {r["id"]: r["score"] for r in got} == pytest.approx(want)


def test_pca_error_against_svd(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    got = centre.pca_reconstruction(vectors(spark, x), vectors(spark, x), "v", 2).collect()
    z = (x - x.mean(0)) / x.std(0)
    _, _, axes = np.linalg.svd(z)
    want = ((z - z @ axes[:2].T @ axes[:2]) ** 2).sum(1)
    assert [r["score"] for r in sorted(got, key=lambda r: r["id"])] == pytest.approx(list(want))


@pytest.mark.parametrize("rule", ["ecod", "copod"])
def test_tail_scores_equal_one_hot_expansion(spark, rule):
    """The indicator shortcut gives the score of the written-out 0/1 columns."""
    cats = ["u"] * 8 + ["v"] * 3 + ["w"]
    train = spark.createDataFrame([(float(i % 4), c) for i, c in enumerate(cats)], "x double, c string")
    test = spark.createDataFrame([("0", 2.0, "u"), ("1", 9.0, "w"), ("2", -1.0, "new")], "copy_id string, x double, c string")
    short = tails.TailModel(train, ["x"], ["c"]).score(test, rule)
    spell = [(F.col("c") == v).cast("double").alias(f"is_{v}") for v in ("u", "v", "w")]
    names = ["x", "is_u", "is_v", "is_w"]
    full = tails.TailModel(train.select("x", *spell), names).score(test.select("copy_id", "x", *spell), rule)
    a = {r["copy_id"]: r["score"] for r in short.collect()}
    b = {r["copy_id"]: r["score"] for r in full.collect()}
    assert a == pytest.approx(b)


def test_a_task_of_the_knn_join_holds_bounded_matrices():
    """A batch is cut by the numbers its matrices take, however many pivots there are; no row is lost."""
    batch = pd.DataFrame({"id": np.arange(10_000), "vec": [np.zeros(2)] * 10_000})
    for width in (32, 4096, 40_960, 1 << 22):
        pieces = list(neighbours._pieces(batch, width))
        assert all(len(p) == 1 or len(p) * width <= 1 << 20 for p in pieces)
        assert np.concatenate([p["id"] for p in pieces]).tolist() == list(range(10_000))
    assert list(neighbours._pieces(batch[:0], 32)) == []
