"""Exact and SimHash dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.tables import empty, odd, odd_rows
from tidemark.llm import exact, simhash
from tidemark.llm.components import components
from tidemark.sources import staging

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("blocks", [1, 4])
def test_exact_groups_of_odd_rows(spark, blocks):
    groups = {}
    for doc_id, text, *_ in odd_rows():
        groups.setdefault((text or "").translate(UPPER), []).append(doc_id)
    want = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        stays = [True] + [False] * (len(ids) - 1)
        ordered = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        digest = hashlib.sha256(norm.encode()).hexdigest()
        want += [(i, keep, len(ids), k, digest) for i, k in zip(ordered, stays)]
    got = [tuple(r) for r in exact.exact_groups(odd(spark), max_blocks=blocks).collect()]
    key = str
    assert sorted(got, key=key) == sorted(want, key=key)


def test_a_full_filter_loses_nothing(spark):
    """With one block for far too many texts nearly all rows shuffle, and the result is the same."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 50_000).alias("text"))
    got = exact.exact_groups(docs, max_blocks=1)
    assert got.filter("kept").count() == 50_000
    assert got.filter("group_size = 2").count() == 20_000


def test_unique_texts_do_not_shuffle(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    digests = docs.select(exact.text_digest(F.col("text")).alias("d"))
    blocks = exact._blocks(5000, exact.MAX_BLOCKS)
    bitmaps = exact.repeated_cells(digests, "d", blocks)
    assert exact.maybe_repeated(digests, "d", bitmaps, blocks).filter("_maybe").count() < 400


def test_exact_dedup_keeps_columns_and_one_row(spark):
    docs = odd(spark)
    got = exact.exact_dedup(docs)
    assert got.columns == docs.columns
    texts = [(r.text or "").translate(UPPER) for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(UPPER) for _, t, *_ in odd_rows()})
    assert [r.doc_id for r in got.filter("lower(text) = 'a b c'").collect()] == [6]


def test_empty_tables(spark):
    assert exact.exact_groups(empty(spark)).count() == 0
    assert exact.exact_dedup(empty(spark)).count() == 0
    assert simhash.simhash_groups(empty(spark)).count() == 0
    assert simhash.near_dedup(empty(spark)).count() == 0


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if w]
    if not words:
        return 0
    rows = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("bucket", [2, 4096])
def test_simhash_of_odd_rows(spark, bucket):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    values = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(values)
    ids = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            ids[r] = min(ids.get(r, i), i)
    want = sorted((str(i), f"{v:016x}", str(ids.get(r))) for (i, _), v, r in zip(rows, values, roots))
    got = simhash.simhash_groups(odd(spark), bucket=bucket).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_covering_masks_cover_every_triple():
    masks = simhash.covering_masks(2**64 - 1)
    assert len(masks) == 15
    rng = random.Random(1)
    for _ in range(5000):
        bits = rng.sample(range(64), 3)
        assert any(not any(m >> b & 1 for b in bits) for m in masks)
    for _ in range(20):  # and within any free bits, which each mask at least halves, but for rounding
        free = sum(1 << b for b in rng.sample(range(64), rng.randint(5, 40)))
        inner = simhash.covering_masks(free)
        some = [b for b in range(64) if free >> b & 1]
        for _ in range(300):
            bits = rng.sample(some, 3)
            assert any(not any(m >> b & 1 for b in bits) for m in inner)
        assert all(m & ~free == 0 for m in inner)


@pytest.mark.parametrize("bucket", [8, 4096])
def test_a_crowd_of_near_fingerprints(spark, bucket):
    """Chains and a crowd of neighbours: buckets are masked again and no link is lost."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = [base]
    for _ in range(150):
        v = rng.choice(values[-20:])
        for b in rng.sample(range(64), rng.randint(1, 4)):
            v ^= 1 << b
        values.append(v)
    values += [rng.getrandbits(64) for _ in range(50)]
    roots = brute_components(values)
    low = {}
    for i, r in enumerate(roots):
        low[r] = min(low.get(r, i), i)
    signed = [(i, int(np.uint64(v).view(np.int64))) for i, v in enumerate(values)]
    pairs = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.fingerprint_components(pairs, bucket=bucket).collect()}
    assert got == {i: low[r] for i, r in enumerate(roots)}


def test_near_dedup_keeps_one_row_per_component(spark):
    docs = odd(spark)
    got = simhash.near_dedup(docs)
    assert got.columns == docs.columns
    groups = simhash.simhash_groups(docs).select("component_id", "fingerprint").collect()
    roots = brute_components([int(f, 16) for f in sorted({r.fingerprint for r in groups})])
    assert got.count() == len(set(roots))


def test_components_of_a_long_chain(spark):
    n = 10_000
    edges = spark.range(1, n).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    odd_edges = [(n + 1, n + 2), (n + 2, n + 1), (7, 7)] + [(2 * n, 2 * n + i) for i in range(1, 400)]
    edges = edges.unionByName(spark.createDataFrame(odd_edges, "u long, v long"))
    rounds = []
    got = {r.node: r.root for r in components(edges, rounds).collect()}
    star = {2 * n + i: 2 * n for i in range(400)}
    assert got == {**{i: 0 for i in range(n)}, n + 1: n + 1, n + 2: n + 1, **star}
    assert len(rounds) <= 20


def test_components_keep_no_table_of_an_earlier_round(spark):
    before = len(staged(spark))
    edges = spark.range(1, 60).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    components(edges).count()
    assert len(staged(spark)) - before <= 4  # the last edges, nodes and names


def staged(spark):
    root = spark._jvm.org.apache.hadoop.fs.Path(staging.staging_root(spark))
    return list(root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root))
