"""Temperature mixing against a plain computation."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tests.llm.tables import empty, odd, odd_rows, prose
from tidemark.llm import mixing
from tidemark.llm.common import column


def count(text):
    return len((text or "").encode().split()) + 1


def plain_exponent(tokens, budget, target=None, limit=None):
    total = sum(tokens)

    def curve(step):
        powers = [(t / total) ** (step / mixing.GRID) for t in tokens]
        z = sum(powers)
        entropy = -sum(p / z * math.log(p / z) for p in powers)
        return entropy, max(p / z * budget / t for p, t in zip(powers, tokens))

    def first_false(test):
        low, high = -1, mixing.GRID + 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if test(curve(mid)) else (low, mid)
        return high

    step = mixing.GRID
    if target is not None:
        step = max(first_false(lambda c: c[0] >= target) - 1, 0)
    if limit is not None:
        step = max(step if target is not None else 0, min(first_false(lambda c: c[1] > limit), mixing.GRID))
    return step / mixing.GRID


def plain_mix(rows, budget_share, entropy_share, limit, blocks=64, seed=7):
    """rows: (doc_id, source, tokens)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    totals = {s: sum(r[2] for r in rs) for s, rs in by.items()}
    total = sum(totals.values())
    budget = math.floor(total * budget_share)
    target = None if entropy_share is None else entropy_share * math.log(len(by))
    a = plain_exponent(list(totals.values()), budget, target, limit)
    powers = {s: (t / total) ** a for s, t in totals.items()}
    out = []
    for s, rs in by.items():
        quota = math.floor(round(powers[s] / sum(powers.values()) * budget, 3))
        for epoch in range((quota - 1) // totals[s] + 1 if quota > 0 else 0):
            keyed = [(hashlib.md5(f"{seed}|{epoch}|{'' if r[0] is None else r[0]}|{r[2]}".encode()).hexdigest(), r) for r in rs]
            for key, r in keyed:
                place = epoch * totals[s] + sum(x[2] for k, x in keyed if k <= key)
                start = epoch * totals[s] + sum(x[2] for k, x in keyed if k < key)
                if start < quota:  # the document in which the quota ends is used
                    out.append((r[0], s, epoch, r[2], place, start * blocks // quota))
    return out


@pytest.mark.parametrize(("share", "entropy", "limit"), [(1.0, 0.95, 4.0), (0.9, None, 1.0), (2.5, 1.0, None), (1.0, 0.5, 1.5), (3.0, None, 2.0)])
def test_mix_is_the_plain_mix(spark, monkeypatch, share, entropy, limit):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 3)
    rows = [(i, "big" if i % 3 else f"s{i % 4}", prose(i, 5 + i % 40)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs, mixing.word_tokens(F.col("text")), budget_share=share, entropy_share=entropy, max_repeats=limit)
    want = plain_mix([(i, s, count(t)) for i, s, t in rows], share, entropy, limit)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize(("share", "entropy", "limit"), [(1.0, 0.95, 4.0), (0.9, None, 1.0), (2.0, None, 2.0)])
def test_odd_rows(spark, share, entropy, limit):
    rows = [(i, s, count(t)) for i, t, _, s, _ in odd_rows()]
    docs = odd(spark)
    tokens = mixing.word_tokens(column("text"))
    got = mixing.mix(docs, tokens, budget_share=share, entropy_share=entropy, max_repeats=limit)
    want = plain_mix(rows, share, entropy, limit)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    kept = mixing.mixed_documents(docs, tokens, budget_share=share, entropy_share=entropy, max_repeats=limit)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want)


def test_each_block_holds_the_sources_by_weight(spark):
    rows = [(i, "a" if i % 4 else "b", "w " * 9) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.mix(docs, mixing.word_tokens(F.col("text")), entropy_share=0.95, blocks=4)
    shares = {}
    for r in mixed.groupBy("block", "source").agg(F.sum("tokens").alias("t")).collect():
        shares.setdefault(r.source, []).append(r.t)
    for values in shares.values():
        assert len(values) == 4 and max(values) - min(values) <= 20


def test_no_whole_source_in_one_window(spark):
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("=s").alias("_source"), F.lit(2).cast("long").alias("tokens"))
    quotas = mixing.source_quotas(rows, 1.0, None, 4.0)
    stream = mixing.permuted_stream(rows, quotas, 50_000, 7)
    places = stream.agg(F.countDistinct("place").alias("n"), F.max("place").alias("m")).first()
    assert (places.n, places.m) == (50_000, 100_000)


def test_empty_tables(spark):
    tokens = mixing.word_tokens(column("text"))
    assert mixing.mix(empty(spark), tokens).count() == 0
    assert mixing.mixed_documents(empty(spark), tokens).count() == 0


def test_no_source_is_lost_to_a_long_document(spark):
    rows = [(0, "long", "w " * 5000)] + [(i, "big", "w " * 999) for i in range(1, 1001)] + [(2000, "two", "w " * 700), (2001, "two", "w " * 99)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tokens = mixing.word_tokens(F.col("text"))
    kept = mixing.mixed_documents(docs, tokens, budget_share=0.9, entropy_share=None, max_repeats=1.0)
    used = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(used) == len(set(used)) and {0, 2000, 2001} <= set(used)
    assert 890 <= len(used) <= 903
    mixed = mixing.mix(docs, tokens, budget_share=0.9, entropy_share=None, max_repeats=1.0)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(used)
