"""The Merkle manifest against a plain computation."""

import hashlib
import zlib

import pytest

from tests.llm.tables import empty, odd, odd_rows
from tidemark.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(levels, at):
    """Siblings of node ``at`` as (left, right), level by level."""
    path = []
    for level in levels[:-1]:
        low = at - at % 3
        path.append((level[low:at], level[at + 1 : low + 3]))
        at //= 3
    return path


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars), as in the odd table."""
    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        changed = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            changed = text.replace("\n", "")
        hashes = [H(*map(field, (doc_id, source, lang, n_chars, t))) for t in (text, changed)]
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, *hashes, doc_id))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        by[name].sort(key=lambda r: r[:3])
    trees = {name: tree([r[2] for r in by[name]]) for name in names}
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for i, name in enumerate(names):
        for j, (_, _, leaf, tampered, doc_id) in enumerate(by[name]):
            path, folded = climb(trees[name], j) + climb(top, i), tampered
            for left, right in path:
                folded = H(*left, folded, *right)
            proof = H(*[h for left, right in path for h in left + right])
            out.append((doc_id, leaf, trees[name][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def result(docs, **options):
    return sorted((tuple(r) for r in merkle.manifest(docs, **options).collect()), key=str)


def corpus(n, sources):
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"s{i % sources}"
        rows.append((i * 7 - 30, f"first line of {i}\nsecond line", "en" if i % 5 else None, source, i))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("n, sources, stride, parts", [(1, 1, 6, 2), (3, 1, 1, 2), (200, 31, 1, 5), (200, 31, 2, 7), (900, 4, 6, 3)])
def test_equals_plain_computation(spark, partitions, n, sources, stride, parts):
    partitions(parts)
    rows = corpus(n, sources)
    assert result(spark.createDataFrame(rows, SCHEMA), stride=stride) == plain(rows)


def test_many_small_sources(spark, partitions):
    partitions(4)
    rows = [(i, "t\n", "en", f"source {i % 1500}", 2) for i in range(2000)]
    assert result(spark.createDataFrame(rows, SCHEMA), stride=3) == plain(rows)


def test_odd_rows(spark, partitions):
    partitions(3)
    assert result(odd(spark)) == plain(odd_rows())


def test_empty_table(spark):
    assert result(empty(spark)) == []


def test_tampering_breaks_only_texts_with_newlines(spark):
    rows = corpus(60, 3) + [(10_000 + i, "one line", "en", "s1", 1) for i in range(20)]
    for doc_id, *_, verified in result(spark.createDataFrame(rows, SCHEMA)):
        hit = doc_id < 10_000 and zlib.crc32(str(doc_id).encode()) % 2 == 0
        assert verified != hit
