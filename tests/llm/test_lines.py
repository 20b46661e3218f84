"""Line dedup against a plain computation."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm.tables import SCHEMA, empty, odd, odd_rows
from tidemark.llm import lines


def plain(rows, least_chars=20, least_docs=3):
    """rows: (doc_id, text); null ids are one document, the smallest."""

    def order(doc_id):
        return lines.NO_ID if doc_id is None else doc_id

    def key(line):
        stripped = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)

    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(order(doc_id))
    out = []
    for doc_id, text in rows:
        each = (text or "").split("\n")
        kept = []
        for line in each:
            held = holders[key(line)]
            if len(key(line)) < least_chars or len(held) < least_docs or order(doc_id) == max(held):
                kept.append(line)
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc_id, len(each), len(each) - len(kept), digest))
    return sorted(out, key=str)


def result(docs, **options):
    rows = lines.kept_digests(docs, lines.keep_bitmaps(docs, **options)).collect()
    return sorted((tuple(r) for r in rows), key=str)


def corpus(seed, documents=300):
    rng = random.Random(seed)
    pool = [f"Shared line number {i} of the corpus" for i in range(12)] + ["é" * 20, "é" * 19, "short", "  ", ""]
    rows = []
    for i in range(documents):
        own = [f"  only here {i} {j} and nowhere else\t" for j in range(rng.randint(0, 3))]
        texts = own + [rng.choice(pool) for _ in range(rng.randint(0, 6))]
        texts += ["A LINE THAT nearly every document holds\r"] * rng.choice([0, 1, 1, 3])
        rng.shuffle(texts)
        rows.append((i * 3 - 50, "\n".join(t.upper() if rng.random() < 0.2 else t for t in texts)))
    return rows


@pytest.mark.parametrize("n", [1, 3, 40])
def test_equals_plain_computation(spark, partitions, n):
    partitions(n)  # with 40 partitions the common line fills several of them
    rows = corpus(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == plain(rows)


def test_odd_rows(spark, partitions):
    partitions(5)
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert result(odd(spark)) == plain(rows)
    assert result(odd(spark), least_docs=2, least_chars=5) == plain(rows, 5, 2)


def test_empty_table(spark):
    assert result(empty(spark)) == []


def test_a_line_repeated_within_documents(spark, partitions):
    partitions(6)
    line = "a line of more than twenty characters"
    rows = [(i, "\n".join([line] * 5000 + [f"its own line number {i} and more"])) for i in range(4)] + [(9, line), (9, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == plain(rows)
    assert {r[2] for r in result(docs)} == {0, 5000}


@pytest.mark.parametrize("least", [2, 3, 5])
def test_batches_and_partitions_do_not_matter(least):
    rng = np.random.default_rng(least)
    n = 4000
    h1, h2 = rng.integers(0, 60, n), rng.integers(0, 2, n)
    h1[: n // 3], h2[: n // 3] = 7, 1  # a hot line
    doc, line = rng.integers(0, 300, n), np.arange(n)
    order = np.lexsort((line, -doc, h2, h1))
    rows = [np.ascontiguousarray(c[order]) for c in (h1, h2, doc, np.zeros(n, np.int64), line)]
    held = {}
    for a, b, d in zip(*rows[:3]):
        held.setdefault((a, b), set()).add(d)
    want = {x for a, b, d, _, x in zip(*rows) if len(held[a, b]) >= least and d < max(held[a, b])}
    for parts in (1, 2, 17):
        # equal (hash, document) rows never lie in two partitions
        cuts = sorted(rng.integers(0, n, parts - 1))
        while any(c and all(r[c] == r[c - 1] for r in rows[:3]) for c in cuts):
            cuts = [c + (c < n and bool(c) and all(r[c] == r[c - 1] for r in rows[:3])) for c in cuts]
        bounds, dropped, pending, ends = [0, *cuts, n], [], [], {}
        for low, high in zip(bounds, bounds[1:]):
            state, found, at = lines.FirstOccurrences(least), [], low
            while at < high:
                to = min(high, at + int(rng.integers(1, 50)))
                found += state.feed(*[r[at:to] for r in rows])
                at = to
            found += state.finish()
            assert sum(len(f[0]) for f in found if f[0][0] == lines.SUMMARY) <= 2
            for kind, a, b, d, _, x in (row for f in found for row in zip(*f)):
                if kind == lines.SUMMARY:
                    top, docs = ends.get((a, b), (d, 0))
                    ends[a, b] = max(top, d), docs + x
                else:
                    (dropped if kind == lines.DROPPED else pending).append((a, b, d, x))
        got = [x for *_, x in dropped]
        got += [x for a, b, d, x in pending if (a, b) in ends and ends[a, b][1] >= least and d < ends[a, b][0]]
        assert sorted(got) == sorted(want)


def test_bitmap_round_trip():
    for n in (1, 7, 8, 9, 1000):
        gone = [i for i in range(n) if i % 3 == 1]
        keep = lines.unpack_bitmap(lines.pack_bitmap(n, gone), n)
        assert [i for i in range(n) if not keep[i]] == gone


def test_returns_bitmaps_not_text(spark):
    docs = spark.createDataFrame(corpus(5), "doc_id long, text string")
    assert dict(lines.keep_bitmaps(docs).dtypes) == {
        "doc": "bigint", "tie": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "keep": "binary"
    }
    assert "_row" in SCHEMA  # odd() brings clashing names
