"""Sketches of numbers: merged parts, quantiles within a tenth, divergence without rows."""

import numpy as np
import pytest

from tidemark.operators import drift


def table(spark, rows):
    return spark.createDataFrame(rows, "year int, x double, y double")


def numbers(seed, n):
    rng = np.random.default_rng(seed)
    return (rng.lognormal(2, 2, n) * rng.choice([-1, 1, 1], n)).tolist()


@pytest.fixture(scope="module")
def rows():
    return [(2000 + i % 2, x, 0.0 if i % 3 else None) for i, x in enumerate(numbers(1, 4000))]


def test_parts_merge_to_the_whole_and_quantiles_are_close(spark, rows):
    whole = drift.numeric_sketch(table(spark, rows), ["x", "y"])
    parts = [drift.numeric_sketch(table(spark, rows[i::3]), ["x", "y"]) for i in range(3)]
    merged = drift.merge_sketches(parts)
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))
    shares = [0.01, 0.25, 0.5, 0.9, 1.0]
    for r in drift.sketch_quantiles(merged, shares).filter("feature = 'x'").collect():
        mine = np.sort([x for year, x, _ in rows if year == r.year])
        want = mine[int(np.ceil(r.share * len(mine))) - 1]
        assert abs(r.value - want) <= 0.1 * abs(want) + 0.001


def test_odd_numbers_have_bins_and_missing_ones_a_group(spark):
    values = [None, float("nan"), 0.0, -0.0, 1e300, -1e300, float("inf"), float("-inf"), 1e-9, -1e-9]
    got = drift.numeric_sketch(table(spark, [(1, v, v) for v in values]), ["x"]).collect()
    assert {r.bin: r.n for r in got} == {None: 2, 1: 3, 233: 2, -233: 2, -1: 1}
    assert drift.numeric_sketch(table(spark, []), ["x"]).count() == 0


def test_divergence_sees_a_moved_feature(spark):
    same, moved = numbers(2, 3000), [3 * x for x in numbers(3, 3000)]
    rows = [(1, a, b) for a, b in zip(same, numbers(4, 3000))] + [(2, a, b) for a, b in zip(numbers(5, 3000), moved)]
    got = {r.feature: r.divergence for r in drift.numeric_divergence(drift.numeric_sketch(table(spark, rows), ["x", "y"])).collect()}
    assert 0 <= got["x"] < got["y"] / 2
