"""SpotSigs fingerprints against sets of plain signatures."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.tables import empty, odd, odd_rows, prose
from tidemark.llm import spotsigs


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ordered(rows):
    """(doc_id, text) in the defined order: no id first, then by id, ties by digest."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    return [(i, t or "") for i, t in sorted(rows, key=key)]


@pytest.mark.parametrize("per_slice", [1, 3, 2000])
def test_next_texts_and_edits(spark, per_slice):
    rows = ordered([(i, t) for i, t, *_ in odd_rows()])
    got = spotsigs.fingerprint_edits(odd(spark), ["the", "of"], per_slice).collect()
    want = [
        (str(i), len(t), hashlib.sha256(edited(t, rows[(n + 1) % len(rows)][1]).encode()).hexdigest())
        for n, (i, t) in enumerate(rows)
    ]
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)


@pytest.mark.parametrize("ids", [list(range(0, 4000, 7)), [i**3 for i in range(60)] + [10**12 + i for i in range(500)], [5], [3, 9]])
def test_order_over_slices(spark, ids):
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(6)
    got = spotsigs.with_next(docs, lambda t: F.array(F.length(t)), 5)
    pairs = {r.doc_id: (r.next_text, r.next_sigs) for r in got.collect()}
    ids = sorted(ids)
    for n, i in enumerate(ids):
        following = f"text {ids[(n + 1) % len(ids)]}"
        assert pairs[i] == (following, [len(following)])


def plain(text, anchors, extra):
    """Signatures as tuples; ``extra``: words that are anchors by their hash."""
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    out = set()
    for i, w in enumerate(words):
        chain = [x for x in words[i + 1 : i + 9] if x not in anchors][:2]
        if (w in anchors or w in extra) and len(chain) == 2:
            out.add((w, *chain))
    return out or {(w, words[i + 1] if i + 1 < len(words) else "") for i, w in enumerate(words)}


def test_signatures_and_likeness_are_those_of_plain_sets(spark):
    anchors = ["the", "of", "and", "in", "is"]
    texts = [prose(i, n) for i, n in enumerate((3, 8, 40, 120, 400))] + ["The of AND", "one", "zz yy xx"]
    words = sorted({w for t in texts for w in t.lower().split()})
    table = spark.createDataFrame([(w,) for w in words], "w string")
    extra = {r.w for r in table.filter(F.pmod(F.hash("w"), F.lit(spotsigs.EXTRA)) == 0).collect()}
    pairs = [(a, edited(a, b)) for a in texts for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = df.withColumn("sa", spotsigs.signatures(F.col("a"), anchors)).withColumn("sb", spotsigs.signatures(F.col("b"), anchors))
    extra |= {r.w for r in df.select(F.explode(F.split(F.lower("b"), " ")).alias("w")).filter(F.pmod(F.hash("w"), F.lit(spotsigs.EXTRA)) == 0).collect()}
    for r in df.withColumn("near", spotsigs.likeness(F.col("sa"), F.col("sb"))).collect():
        x, y = plain(r.a, anchors, extra), plain(r.b, anchors, extra)
        assert (len(r.sa), len(r.sb)) == (len(x), len(y))
        assert r.near == pytest.approx(len(x & y) / len(x | y))


def test_equal_texts_have_equal_fingerprints_and_anchors_are_common(spark):
    docs = spark.createDataFrame([(i, prose(i // 2, 100)) for i in range(40)], "doc_id long, text string")
    assert set(spotsigs.anchor_words(docs, 5)) == {"the", "of", "and", "in", "is"}
    got = {r.doc_id: r for r in spotsigs.fingerprint_edits(docs).collect()}
    for i in range(0, 40, 2):
        assert got[i].fingerprint == got[i + 1].fingerprint
        assert got[i].near_next == 1.0
        assert len(got[i].fingerprint) == 8 * got[i].n_signatures
        assert got[i + 1].near_edited > 0.15 > got[i + 1].near_next


def test_pairs_of_similar_sets(spark):
    base = [prose(i, 150).split() for i in range(20)]
    texts = {i: " ".join(w) for i, w in enumerate(base)}
    for i in range(5):
        texts[100 + i] = " ".join(base[i][:70] + ["changed"] + base[i][71:])
        texts[200 + i] = texts[i]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    anchors = ["the", "of", "and", "in", "is"]
    sets = docs.select("doc_id", spotsigs.signatures(F.col("text"), anchors).alias("sigs"))
    known = {r.doc_id: frozenset(r.sigs) for r in sets.collect()}
    got = {r.doc_id: r.class_id for r in spotsigs.similar_classes(sets, 0.8).collect()}
    for i, a in known.items():
        for j, b in known.items():
            if len(a & b) / len(a | b) >= 0.8:
                assert got[i] == got[j]
            elif i < j and got[i] == got[j]:  # only through others
                assert any(len(a & c) / len(a | c) >= 0.8 for k, c in known.items() if k != i)
    assert len(set(got.values())) == 20


def test_chains_of_similar_sets_stay_one_class(spark):
    """A-B and B-C are alike, A-C are not, and A has rare signatures in common with both; against brute force."""
    known = {}
    for k in range(16):
        at = k * 10_000
        b, own = set(range(at + 1, at + 37)), set(range(at + 101, at + 105))
        a = b - set(range(at + 1, at + 5)) | own
        c = b - set(range(at + 5, at + 9)) | set(range(at + 201, at + 205))
        for i, s in enumerate((a, b, c)):
            known[10 * k + i] = s
        for i in range(3, 9):  # make 1..4 and A's own four common
            known[10 * k + i] = own | set(range(at + 1, at + 5)) | set(range(at + 1000 * i, at + 1000 * i + 40))
    root = {i: i for i in known}
    for i, x in known.items():
        for j, y in known.items():
            if len(x & y) / len(x | y) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {n: low if r == high else r for n, r in root.items()}
    rows = [(i, [f"{v:06d}" for v in sorted(s)]) for i, s in known.items()]
    sets = spark.createDataFrame(rows, "doc_id long, sigs array<string>")
    assert {r.doc_id: r.class_id for r in spotsigs.similar_classes(sets, 0.8).collect()} == root
    assert all(root[10 * k] == root[10 * k + 1] == root[10 * k + 2] for k in range(16))


def test_empty_tables(spark):
    assert spotsigs.fingerprint_edits(empty(spark)).count() == 0
