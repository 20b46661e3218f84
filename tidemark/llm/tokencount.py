"""Token counts under a unigram vocabulary, without building the tokens.

Count-only Viterbi: an Aho-Corasick automaton enumerates every vocabulary entry that ends at each
character; dynamic programming carries the best score and the number of pieces on that best path.
Ties follow the unigram tokenizer: extensions are tried by start position, a later one wins only
with a strictly higher score, and a character that is no entry of its own costs the lowest score
less ten. Runs of unknown characters count as their UTF-8 bytes where the vocabulary has all byte
pieces, and as one piece otherwise.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import column, documents, small_batches
from tidemark.llm.registry import query

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the unigram tokenizer
MEMO = 300_000  # words whose counts a Python worker remembers
GRID = 2.0**-10  # scores that are multiples of this add up without rounding
WORD = re.compile(f"{SPACE}*[^{SPACE}]*")


class Unigram:
    """Counts pieces of normalised text. ``vocab``: (piece, score) by id; ``unknown``: the unknown id."""

    def __init__(self, vocab: list[tuple[str, float]], unknown: int = 0):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        scores = dict(vocab)
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.lowest = min(score for _, score in vocab) - UNKNOWN_PENALTY
        self.bytes_known = all(f"<0x{b:02X}>" in scores for b in range(256))
        # words are independent if no entry reaches across the start of a word and sums are exact
        crossing = any(SPACE in piece.lstrip(SPACE) for piece in scores)
        on_grid = all(score / GRID == int(score / GRID) and abs(score) < 2.0**40 for score in scores.values())
        self.by_word = not crossing and on_grid and self.bytes_known
        self.memo: dict[str, tuple[float, int]] = {}

    def viterbi(self, text: str) -> tuple[float, int]:
        """(best score, pieces on the best path) of one text."""
        size = len(text)
        score = [0.0] * (size + 1)
        pieces = [0] * (size + 1)
        in_unknown = [False] * (size + 1)
        ends = iter(self.automaton.iter(text))
        found = next(ends, None)
        for end in range(1, size + 1):
            best, count, unknown = None, 0, False
            single = None
            matches = []
            while found is not None and found[0] == end - 1:
                matches.append(found[1])
                found = next(ends, None)
            # longest first: earlier starts are tried earlier, as the tokenizer goes by start
            matches.sort(reverse=True)
            for length, value in matches:
                if length == 1:
                    single = value
                candidate = value + score[end - length]
                if best is None or candidate > best:
                    best, count, unknown = candidate, pieces[end - length] + 1, False
            if single is None:
                candidate = self.lowest + score[end - 1]
                if best is None or candidate > best:
                    best, unknown = candidate, True
                    if self.bytes_known:
                        count = pieces[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
                    else:
                        count = pieces[end - 1] + (not in_unknown[end - 1])
            score[end], pieces[end], in_unknown[end] = best, count, unknown
        return score[size], pieces[size]

    def count(self, normalised: str) -> tuple[float, int]:
        if not self.by_word:
            return self.viterbi(normalised)
        memo = self.memo
        score, pieces = 0.0, 0
        for word in WORD.findall(normalised):
            known = memo.get(word)
            if known is None:
                known = self.viterbi(word)
                if len(word) < 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = known
            score += known[0]
            pieces += known[1]
        return score, pieces


def read_vocabulary(path: str):
    """(pieces with scores by id, unknown id, normaliser) of a piece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    vocab = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    return vocab, model.unk_id(), model.normalize


_counters: dict[str, tuple] = {}


def counter(path: str) -> tuple:
    """(Unigram, normaliser), one per Python worker."""
    if path not in _counters:
        vocab, unknown, normalise = read_vocabulary(path)
        _counters[path] = Unigram(vocab, unknown), normalise
    return _counters[path]


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_chars, n_tokens, score): pieces of every whole text and the best path's score.

    Null and empty texts have no characters, no tokens and score 0. One row per row of ``docs``;
    repeated rows are kept, extra columns ignored. No shuffle: rows are counted where they are read.
    """
    kind = dict(docs.select(column("doc_id").alias("doc_id")).dtypes)["doc_id"]

    def run(batches):
        unigram, normalise = counter(model)
        for batch in batches:
            chars, counts, scores = [], [], []
            for text in batch.column(1).to_pylist():
                score, n = unigram.count(normalise(text)) if text else (0.0, 0)
                chars.append(len(text or ""))
                counts.append(n)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chars, pa.int64()), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())],
                ["doc_id", "n_chars", "n_tokens", "score"],
            )

    small_batches(docs.sparkSession)
    source = docs.select(column("doc_id").alias("doc_id"), column("text").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, n_chars long, n_tokens long, score double")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), default_model())
