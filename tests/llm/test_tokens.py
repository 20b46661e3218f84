"""Packing and token counts against the tokenizers themselves."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, models

from tests.llm.tables import empty, odd, odd_rows, odd_texts, prose
from tidemark.llm import packing, tokencount

PATH = packing.default_tokenizer()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_words_give_the_tokenizer_s_ids(tokenizer):
    encoder = packing.Encoder(PATH)
    hard = ["a  b\n\n c\t d  ", " x", "   zz \x1c q é漢字", " don't  we'll 12 345%%% \n \n", "x <|endoftext|> y", "　 a  b"]
    for text in [t or "" for t in odd_texts()] + hard:
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def check_layout(rows, texts, length, tokenizer):
    """Every id of every row lies in exactly one piece, sequences have no gaps, and digests agree."""
    by_row, by_sequence = {}, {}
    for r in rows:
        by_row.setdefault(r.row_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    left = sorted((str(i), t or "") for i, t in texts)
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r.start)
        at = 0
        for p in pieces:
            assert p.start == at and p.length > 0
            at += p.length
        assert at == pieces[0].doc_tokens
        key = next(
            (i, t) for i, t in left
            if i == str(pieces[0].doc_id) and len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 == at
            and all(
                zlib.crc32(np.array((tokenizer.encode(t, add_special_tokens=False).ids + [0])[p.start : p.start + p.length], "<u4").tobytes())
                == p.ids_crc32
                for p in pieces
            )
        )
        left.remove(key)
    assert not left
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert at == pieces[0].tokens <= length
        alone = at & (at - 1) == 0
        assert {p.padded_length for p in pieces} == {at if alone else length}


@pytest.mark.parametrize(("length", "windows"), [(1024, 64), (64, 2), (16, 1)])
def test_packing_of_odd_rows(spark, tokenizer, length, windows):
    docs = odd(spark).filter("text IS NULL OR length(text) < 20000").repartition(5)
    texts = [(i, t) for i, t, *_ in odd_rows() if t is None or len(t) < 20000]
    check_layout(packing.pack(docs, PATH, length, windows, min_cut=4).collect(), texts, length, tokenizer)


def test_little_padding(spark):
    docs = spark.createDataFrame([(i, prose(i, 20 + i % 700)) for i in range(600)], "doc_id long, text string")
    rows = packing.pack(docs.repartition(4), PATH).collect()
    used = sum(r.length for r in rows)
    laid = sum({r.sequence_id: r.padded_length for r in rows}.values())
    assert laid - used < 0.02 * used


def test_whole_windows_are_merged():
    moved = packing.merge_windows([(1, 600), (2, 500), (3, 400), (4, 424), (5, 24)], 1024)
    fills = {}
    for window, target, base, total in moved:
        fills.setdefault(target, []).append((base, dict([(1, 600), (2, 500), (3, 400), (4, 424), (5, 24)])[window], total))
    for parts in fills.values():
        at = 0
        for base, fill, total in sorted(parts):
            assert base == at
            at += fill
        assert at == total <= 1024
    assert len(fills) == 2


def test_merging_the_last_windows_of_many_tasks(spark, tokenizer):
    docs = spark.createDataFrame([(i, prose(i, 40)) for i in range(60)], "doc_id long, text string").repartition(30)
    rows = packing.pack(docs, PATH, merge_rows=8).collect()
    check_layout(rows, [(i, prose(i, 40)) for i in range(60)], 1024, tokenizer)
    assert len({r.sequence_id for r in rows}) < 20


@pytest.fixture(scope="module")
def unigram():
    vocab, unknown, normalise = tokencount.read_vocabulary(tokencount.default_model())
    return tokencount.Unigram(vocab, unknown), Tokenizer(models.Unigram(vocab, unknown, True)), normalise


def test_counts_are_the_unigram_tokenizer_s(unigram):
    mine, reference, normalise = unigram
    for text in odd_texts() + ["<s> <0x41> </s>", "ab́c  d", "▁ ▁▁x▁", "�\x00 \x7f"]:
        if text:
            assert mine.count(normalise(text))[1] == len(reference.encode(normalise(text)).ids), text[:40]


def test_ties_and_unknowns_in_a_small_vocabulary():
    """Equal scores, scores off the grid, runs of unknown characters: as the tokenizer decides."""
    rng = np.random.default_rng(3)
    letters = "abcd"
    for trial in range(60):
        pieces = {"".join(rng.choice(list(letters[:3]), rng.integers(1, 4))) for _ in range(8)}
        scores = rng.integers(-3, 0, len(pieces)) * (1.0 if trial % 2 else 0.1)
        vocab = [("<unk>", -9.0), *zip(sorted(pieces), map(float, scores))]
        mine, reference = tokencount.Unigram(vocab, 0), Tokenizer(models.Unigram(vocab, 0, False))
        for _ in range(20):
            text = "".join(rng.choice(list(letters), rng.integers(1, 14)))
            assert mine.count(text)[1] == len(reference.encode(text).ids), (vocab, text)


def test_token_counts_of_odd_rows(spark, unigram):
    mine, _, normalise = unigram
    got = sorted((str(r.doc_id), r.n_chars, r.n_tokens) for r in tokencount.token_counts(odd(spark), tokencount.default_model()).collect())
    want = sorted((str(i), len(t or ""), mine.count(normalise(t))[1] if t else 0) for i, t, *_ in odd_rows())
    assert got == want


def test_empty_tables(spark):
    assert packing.pack(empty(spark), PATH).count() == 0
    assert tokencount.token_counts(empty(spark), tokencount.default_model()).count() == 0
