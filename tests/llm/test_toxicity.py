"""The network's gradients, its learning, and the scoring of whole texts."""

import zlib

import numpy as np
import pytest

from tests.llm.tables import empty, labels, odd, odd_rows, prose
from tidemark.llm import toxicity
from tidemark.llm.gru import Network, word_pieces


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    words = ["ab", "abc", "q", "toolongword"]
    net = Network.start({"ab": 1, "q": 2}, embed=3, char_embed=3, char_hidden=2, hidden=3, attention=3, seed=1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    index = rng.integers(0, 4, (5, 6))
    mask = (np.arange(5)[:, None] < np.array([5, 3, 1, 4, 2, 5])).astype(float)
    y = np.array([0, 1, 1, 0, 1, 0.0])

    def loss():
        vectors, _ = net.word_vectors(words)
        table = np.concatenate([vectors @ net.params[f"w_w{d}"] + net.params[f"w_b{d}"] for d in "fb"], axis=1)
        z = net.logits(table, index, mask)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grads = net.gradients(words, index, mask, y)
    for name, g in grads.items():
        value = net.params[name]
        flat = np.flatnonzero(g.ravel())
        for at in rng.choice(flat, min(5, len(flat)), replace=False):
            at = np.unravel_index(at, value.shape)
            kept = value[at]
            value[at] = kept + 1e-5
            up = loss()
            value[at] = kept - 1e-5
            down = loss()
            value[at] = kept
            assert (up - down) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-7), name


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        starts = toxicity.windows(n)
        covered = {w for s in starts for w in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n))
        assert all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))
    assert word_pieces(["a" * 70, "b"]) == ["a" * 32, "a" * 32, "a" * 6, "b"]


@pytest.fixture(scope="module")
def sample():
    rows = []
    for i in range(240):
        words = prose(i, 20 + i % 150).split()
        if i % 3 == 0:
            words[(i * 7) % len(words)] = ("vilebeast", "grubworm")[i % 2]
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def scorer(sample):
    return toxicity.train(sample)


def test_it_learns_and_finds_one_word_anywhere(scorer):
    clean = [prose(1000 + i, 60 + 40 * i) for i in range(40)]
    foul = []
    for i, t in enumerate(clean):
        words = t.split()
        words[(i * 13) % len(words)] = "grubworm"
        foul.append(" ".join(words))
    assert (scorer.scores(clean) < 0.5).mean() > 0.9
    assert (scorer.scores(foul) >= 0.5).mean() > 0.9
    # the whole text counts, its very end included
    assert scorer.scores([prose(5, 5000) + " grubworm"])[0] > 0.5


def test_blocks_do_not_change_scores(scorer, monkeypatch):
    texts = [prose(i, 10 + 97 * i) for i in range(12)] + ["", None]
    whole = scorer.scores(texts)
    monkeypatch.setattr(toxicity, "BLOCK", 3)
    assert np.allclose(whole, [scorer.scores([t])[0] for t in texts], atol=1e-5)


def test_without_two_classes_the_score_is_constant(spark):
    assert toxicity.train([]).scores(["a"])[0] == 0.5
    assert toxicity.train([("a", 0)]).scores(["a"])[0] == 0.0


def test_held_out_rows_are_never_learnt_from(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    marked = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    used = {int(t.split()[1]) for t, _ in toxicity.training_sample(docs, marked, 1000, 1000)}
    assert used == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert len(toxicity.training_sample(docs, marked, 7, 11)) == 18


def test_odd_rows(spark, scorer):
    docs = odd(spark)
    got = toxicity.toxicity(docs, labels(spark), scorer).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in odd_rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    kept = toxicity.clean_documents(docs, labels(spark), scorer)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.toxicity(docs, labels(spark)).count() == len(got)  # labels of an odd kind: nulls, twice, one class


def test_empty_tables(spark):
    assert toxicity.toxicity(empty(spark), labels(spark)).count() == 0
    assert toxicity.clean_documents(empty(spark), labels(spark, [])).count() == 0
