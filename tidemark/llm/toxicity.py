"""Toxicity scores from a bidirectional gated recurrent network over words and their characters.

The network is trained on the driver from a bounded sample of labelled rows, and scores all
overlapping windows of every whole text in the tasks. A document's score is that of its worst window.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import column, documents, packed, small_batches, unpacked
from tidemark.llm.gru import Adam, Network, word_pieces
from tidemark.llm.registry import query

WINDOW = 32
STRIDE = 16
TOXIC_ROWS, CLEAN_ROWS = 1000, 2500  # labelled rows that the network learns from, at most
TRAIN_CHARS = 20_000  # only labelled texts up to this length are learnt from, so the sample has a bounded size
VOCABULARY = 20_000  # words with an embedding of their own; the others are known by their characters
MIN_COUNT = 4
MEMO = 300_000  # words whose projections a Python worker remembers
BLOCK = 4096  # windows scored at once

WORDS = re.compile(r"[^\W\d_]+")


def split_words(text: str | None) -> list[str]:
    return word_pieces(WORDS.findall((text or "").lower()))


def windows(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Starts of overlapping windows that cover n words; one empty window for none."""
    return list(range(0, max(n - window, 0) + stride, stride)) if n > window else [0]


class Scorer:
    """Scores texts with a trained network; remembers the projections of words, up to MEMO of them."""

    def __init__(self, network: Network, scale: float = 1.0, shift: float = 0.0, constant: float | None = None):
        self.network, self.scale, self.shift, self.constant = network, scale, shift, constant
        self.forget()

    def forget(self):
        self.rows: dict[str, int] = {"": 0}
        self.table: np.ndarray | None = None

    def __getstate__(self):  # what is remembered stays where it was made
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def _index(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.rows) > MEMO:
            self.forget()
        known = self.rows
        new = list({w for words in texts for w in words if w not in known})
        if self.table is None:
            self.table = np.zeros_like(self.network.projections([" "]))  # row 0: no word
        if new:
            size = len(known) + len(new)
            if size > len(self.table):  # grown by doubling
                bigger = np.zeros((max(size, 2 * len(self.table)), self.table.shape[1]), np.float32)
                bigger[: len(known)] = self.table[: len(known)]
                self.table = bigger
            self.table[len(known) : size] = self.network.projections(new)
            known.update(zip(new, range(len(known), size)))
        return [np.fromiter((known[w] for w in words), np.int32, len(words)) for words in texts]

    def worst(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(logit of the worst window, its start) of each text."""
        best = np.full(len(texts), -np.inf, np.float32)
        place = np.zeros(len(texts), np.int64)
        index = self._index(texts)
        owner, start, length = [], [], []
        for i, rows in enumerate(index):
            for s in windows(len(rows)):
                owner.append(i)
                start.append(s)
                length.append(min(WINDOW, len(rows) - s))
        if not owner:
            return best, place
        offsets = np.cumsum([0, *map(len, index)])
        everything = np.concatenate([*index, np.zeros(WINDOW + STRIDE, np.int32)])
        owner, start, length = np.array(owner), np.array(start), np.maximum(np.array(length), 0)
        steps = np.arange(WINDOW)[:, None]
        for at in range(0, len(owner), BLOCK):
            part = slice(at, at + BLOCK)
            mask = (steps < length[part]).astype(np.float32)
            rows = everything[np.minimum(offsets[owner[part]] + start[part] + steps, len(everything) - 1)]
            logits = self.network.logits(self.table, np.where(mask > 0, rows, 0), mask)
            o, s = owner[part], start[part]
            highest = np.full(len(texts), -np.inf, np.float32)
            np.maximum.at(highest, o, logits)
            hit = (logits > best[o]) & (logits == highest[o])
            best[o[hit]], place[o[hit]] = logits[hit], s[hit]
        return best, place

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.zeros(len(texts))
        words = [split_words(t) for t in texts]
        at = 0
        while at < len(texts):  # blocks of texts with a bounded number of words
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(words[end]) <= 200_000):
                size += len(words[end])
                end += 1
            logit = self.worst(words[at:end])[0].astype(np.float64) * self.scale + self.shift
            out[at:end] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            at = end
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> list[tuple[str, int]]:
    """At most so many labelled texts of each class that are not held out, chosen by a hash of the id.

    A document labelled twice counts as toxic if either label says so; null labels are left out.
    """
    marked = labels.select(column("doc_id").alias("doc_id"), column("toxic").alias("toxic")).dropna()
    marked = marked.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(column("doc_id").alias("doc_id"), column("text").alias("text"))
    short = texts.filter(F.length("text") <= TRAIN_CHARS)
    order = F.md5(F.concat(F.lit("sample|"), F.col("doc_id").cast("string")).cast("binary"))
    parts = [
        marked.filter(is_class).orderBy(order, "doc_id").limit(rows)
        for is_class, rows in ((F.col("toxic") == 1, toxic_rows), (F.col("toxic") != 1, clean_rows))
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most toxic_rows + clean_rows ids
    rows = short.join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").collect()
    return [(r.text, int(r.toxic == 1)) for r in sorted(rows, key=lambda r: r.doc_id)]


def train(sample: list[tuple[str, int]], rounds: int = 8, batch: int = 256, seed: int = 0) -> Scorer:
    """Fit the network: windows with their document's label first, then each document's worst windows.

    With rows of one class only, or none, every text scores that class's share (a half for none).
    """
    labels = np.array([y for _, y in sample], np.float32)
    if len(set(labels.tolist())) < 2:
        return Scorer(Network({}, {}), constant=float(labels.mean()) if len(labels) else 0.5)
    texts = [split_words(t) for t, _ in sample]
    counts: dict[str, int] = {}
    for words in texts:
        for w in set(words):
            counts[w] = counts.get(w, 0) + 1
    common = sorted((w for w, n in counts.items() if n >= MIN_COUNT), key=lambda w: (-counts[w], w))[:VOCABULARY]
    network = Network.start({w: i + 1 for i, w in enumerate(common)}, seed=seed)
    adam = Adam(network.params)
    rng = np.random.default_rng(seed)

    def learn(chosen: list[tuple[int, int]]) -> None:
        for at in range(0, len(chosen), batch):
            part = chosen[at : at + batch]
            cut = [texts[i][s : s + WINDOW] for i, s in part]
            words = sorted({w for c in cut for w in c})
            if not words:
                continue
            rows = {w: i for i, w in enumerate(words)}
            index = np.zeros((WINDOW, len(part)), np.int64)
            mask = np.zeros((WINDOW, len(part)), np.float32)
            for b, c in enumerate(cut):
                index[: len(c), b] = [rows[w] for w in c]
                mask[: len(c), b] = 1
            adam.step(network.gradients(words, index, mask, labels[[i for i, _ in part]]))

    every = [(i, s) for i, words in enumerate(texts) for s in windows(len(words))]
    weight = np.array([1.0 / len(windows(len(texts[i]))) for i, _ in every])
    first = rng.choice(len(every), size=40 * batch, p=weight / weight.sum())
    learn([every[i] for i in first])
    for _ in range(rounds):
        scorer = Scorer(network)
        _, place = scorer.worst(texts)
        worst = [(i, int(s)) for i, s in enumerate(place)]
        other = [(i, int(rng.choice(windows(len(texts[i]))))) for i in np.flatnonzero(labels == 0)]
        chosen = worst + worst + other
        chosen *= max(1, 6 * batch // len(chosen))
        learn([chosen[i] for i in rng.permutation(len(chosen))])
    scorer = Scorer(network)
    logit = scorer.worst(texts)[0].astype(np.float64)
    scale, shift = 1.0, 0.0
    for _ in range(300):  # Platt scaling of the documents' logits
        error = 1 / (1 + np.exp(-np.clip(scale * logit + shift, -30, 30))) - labels
        scale = max(0.05, scale - 0.05 * float((error * logit).mean()))
        shift -= 0.05 * float(error.mean())
    return Scorer(network, scale, shift)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Scorer:
    return train(training_sample(docs, labels, toxic_rows, clean_rows))


_scorers: dict[int, Scorer] = {}


def score_rows(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) of every whole text; null counts as empty, whose score is that of an empty window."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # a vocabulary and weights of bounded size
    kind = dict(docs.select(column("doc_id").alias("doc_id")).dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            scores = pa.array(shared.value.scores(b.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), scores], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    source = docs.select(column("doc_id").alias("doc_id"), column("text").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; extra columns are ignored."""
    scored = score_rows(docs, scorer or fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def clean_documents(docs: DataFrame, labels: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer or fit(docs, labels))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores([t if isinstance(t, str) else None for t in text]))

    small_batches(docs.sparkSession)
    rows = docs.select(packed(docs).alias("_row"), score(column("text")).alias("_score"))
    return unpacked(rows.filter("_score < 0.5"), "_row", docs.columns)


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
