"""Hard negatives against a plain computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vec string, ab int, rank string"


def plain(rows):
    used = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        used.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for anchor, label, a in used:
        if anchor % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a, v)), i, other) for i, other, v in used if i != anchor))
        for ps, positive, _ in [s for s in scored if s[2] == label][:5]:
            hard = [(-s, i) for s, i, other in scored if other != label and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(anchor, positive, rank, i, -ps, s) for rank, (s, i) in enumerate(hard[:10], 1)]
    return sorted(out)


def result(spark, rows, **blocks):
    df = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)
    vectors = negatives.mislabelled(negatives.whole_vectors(df))
    found = negatives.hard_negatives(vectors, F.col("id") % 100 == 0, **blocks).collect()
    return sorted(tuple(r) for r in found)


def corpus(n, width=16, labels=10, seed=1, hot=0.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(width)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = 0 if rng.random() < hot else rng.randrange(labels)
        rows.append((i, [x + rng.gauss(0, 0.3) for x in centres[label]], label))
    return rows


@pytest.mark.parametrize("n, hot, blocks", [(700, 0.0, {}), (900, 0.5, {"anchor_block": 2, "row_block": 60}), (400, 0.0, {"row_block": 7})])
def test_equals_plain_computation(spark, n, hot, blocks):
    rows = corpus(n, seed=n, hot=hot)
    got = result(spark, rows, **blocks)
    assert got == plain(rows) and got


def test_ties_copies_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)], rng.randrange(3)) for i in range(450)]
    rows += [(1000, None, 1), (1001, [0.5, None, 1.0, 1.0], 1), (1100, [float("nan"), 1.0, 1.0, 1.0], 1), (1200, [1.0] * 4, None)]
    rows += [(1300, [float("inf"), 0.0, 0.0, 0.0], 2), (None, [1.0] * 4, 1), (-100, [1.0] * 4, 1), (-700, [-1.0] * 4, 2), (1400, [0.0] * 4, 9)]
    got = result(spark, rows, row_block=50)
    assert got == plain(rows) and got


def test_empty_table_and_lone_anchor(spark):
    assert result(spark, []) == []
    assert result(spark, [(100, [1.0, 0.0], 1)]) == []
    assert result(spark, [(100, [1.0, 0.0], 1), (101, [], 1), (102, [0.5], 2)]) == []


def test_whole_numbers_beyond_doubles(spark):
    big = 2.0**20
    rows = [(100, [big, 1.0, 0.5], 1), (101, [big, big, 1.0], 1)] + [(200 + i, [0.5 * big, float(i), 1.0], 2) for i in range(1, 20)]
    got = result(spark, rows)
    assert got == plain(rows) and got


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 24)) + 1, rng.normal(size=(300, 24)) + 1
    exact, width = a @ b.T, None
    for segments in (1, 2, 6, 12, 24):
        low, high = negatives.bounds(negatives.summaries(a, segments), negatives.summaries(b, segments))
        assert (low <= exact).all() and (exact <= high).all()
        assert width is None or (high - low).mean() < width
        width = (high - low).mean()
    assert width < 1e-4  # single components: the bounds meet


def test_segments_rule_out_rows_before_exact_scoring():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 32)) * 3
    rows = np.floor(256 * np.repeat(centres, 200, axis=0) + 20 * rng.normal(size=(4000, 32)))
    anchors = rows[::400]
    every = np.full((10, 1), -(2**63)), np.full((10, 1), 2**63 - 1)
    none = lambda at: np.zeros((10, len(rows[at])), bool)
    i, _, j, score, scored = negatives.best_in_ranges(anchors, rows, np.arange(len(rows)), none, *every, 5, tile=500)
    assert scored < 0.3 * len(anchors) * len(rows)
    for at in range(len(anchors)):
        want = np.sort(rows @ anchors[at])[::-1][:5]
        assert (np.sort(score[i == at])[::-1][:5] == want).all()
