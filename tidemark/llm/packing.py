"""Packing documents into fixed-length training sequences.

Bounded-space online packing: a task keeps a fixed number of open windows, puts what is left of a
document into the best fit, and emits the fullest window when none fits - after topping it up with
the first ids of that document, as texts may be cut anywhere. At the end of a task its open windows
are merged into full ones but for one; the last ones of all tasks are merged as wholes.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import column, documents, small_batches
from tidemark.llm.registry import query
from tidemark.sources.staging import stage

LENGTH = 1024
OPEN_WINDOWS = 64
MIN_CUT = 16  # a document is cut to top up a window only if at least this many ids go there
MEMO = 200_000  # words whose ids a task remembers
END_ID = 0

# fixed value: the pre-tokenisation pattern of byte-level BPE
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# a space next to other white space; anywhere else a space starts a new word of the pattern above
NO_CUT = re.compile(r" \s|\s |^ | $")
CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_table() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable character: printable bytes as themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes, equal to those of the tokenizer file.

    The text is cut before single spaces, where no token can reach across, and the ids of each word
    are remembered. Texts that hold a special token's string go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = _byte_table()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {
            bytes(table[c] for c in token): rank
            for token, rank in spec["model"]["vocab"].items()
            if token not in special
        }
        self.exact = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [re.escape(s) for s in sorted(special)]
        self.has_special = re.compile("|".join(self.special)) if self.special else None
        self.memo: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        ids = np.array(self.fast.encode_ordinary(word), "<u4").tobytes()
        if len(word) < 64:
            self.memo[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.has_special and self.has_special.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = CUT.split(text) if NO_CUT.search(text) else text.split(" ")
        memo = self.memo
        out = []
        lead = ""
        for word in words:
            word = lead + word
            lead = " "
            out.append(memo.get(word) or self._word(word))
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Packs the documents of one task; ``done`` collects rows of closed sequences."""

    def __init__(self, first_id: int, length: int = LENGTH, windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT):
        self.length, self.windows, self.min_cut = length, windows, min_cut
        self.next_id = first_id
        self.open: list[tuple[int, int]] = []  # (room, window), sorted
        self.pieces: dict[int, list] = {}  # window -> [(document, start, ids)]
        self.done: list[tuple] = []

    def close(self, pieces: list, is_open: bool = False) -> None:
        offset = 0
        total = sum(len(ids) // 4 for _, _, ids in pieces)
        for document, start, ids in pieces:
            n = len(ids) // 4
            self.done.append((*document, start, n, zlib.crc32(ids), self.next_id, offset, total, is_open))
            offset += n
        self.next_id += 1

    def add(self, document: tuple, ids: bytes) -> None:
        """``document`` = (doc_id, row_id, doc_tokens)."""
        size, start, end = 4 * self.length, 0, len(ids) // 4
        while end - start >= self.length:
            self.close([(document, start, ids[4 * start : 4 * start + size])])
            start += self.length
        while start < end:
            need = end - start
            at = bisect_left(self.open, (need, -1))
            if at < len(self.open):  # best fit: the least room that is enough
                room, window = self.open.pop(at)
                self.pieces[window].append((document, start, ids[4 * start :]))
                if room == need:
                    self.close(self.pieces.pop(window))
                else:
                    insort(self.open, (room - need, window))
                return
            if len(self.open) == self.windows:  # none fits: emit the fullest
                room, window = self.open.pop(0)
                pieces = self.pieces.pop(window)
                if room >= self.min_cut:
                    pieces.append((document, start, ids[4 * start : 4 * (start + room)]))
                    start += room
                self.close(pieces)
                continue
            window = self.next_id
            self.next_id += 1
            self.pieces[window] = [(document, start, ids[4 * start :])]
            insort(self.open, (self.length - need, window))
            return

    def finish(self) -> None:
        """Merge the open windows: the emptiest fill up the fullest, until one is left open."""
        queue = self.open
        while len(queue) > 1:
            room, window = queue.pop(0)
            pieces = self.pieces.pop(window)
            while room and queue:
                left, donor = queue.pop()
                document, start, ids = self.pieces[donor].pop()
                n = len(ids) // 4
                take = min(room, n)
                pieces.append((document, start, ids[: 4 * take]))
                if take < n:
                    self.pieces[donor].append((document, start + take, ids[4 * take :]))
                room -= take
                if self.pieces[donor]:
                    insort(queue, (left + take, donor))
                else:
                    del self.pieces[donor]
            if room == 0:
                self.close(pieces)
            else:
                self.pieces[window] = pieces
                queue.append((room, window))
                break
        for room, window in queue:
            self.close(self.pieces.pop(window), is_open=room > 0)
        self.open = []


def _pieces(docs: DataFrame, tokenizer: str, length: int, windows: int, min_cut: int) -> DataFrame:
    """Pieces of every task's sequences; the last, unfilled sequence of a task is marked open."""
    kind = dict(docs.select(column("doc_id").alias("doc_id")).dtypes)["doc_id"]
    names = ["doc_id", "row_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset", "tokens", "is_open"]
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer).encode
        first = TaskContext.get().partitionId() << 32
        packer = Packer(first, length, windows, min_cut)
        row = first
        doc_type = None

        def flush():
            columns = list(zip(*packer.done))
            packer.done = []
            kinds = [doc_type, *[pa.int64()] * 8, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                packer.add((doc_id, row, len(ids) // 4), ids)
                row += 1
                if len(packer.done) >= 20_000:
                    yield flush()
        packer.finish()
        if packer.done:
            yield flush()

    small_batches(docs.sparkSession)
    longs = ", ".join(f"{n} long" for n in names[1:-1])
    source = docs.select(column("doc_id").alias("doc_id"), column("text").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, {longs}, is_open boolean")


def merge_windows(fills: list[tuple[int, int]], length: int) -> list[tuple[int, int, int, int]]:
    """Whole windows (id, fill), largest first, each into the best fit: (id, new id, base offset, new fill)."""
    room: list[tuple[int, int]] = []  # (room, target)
    members: dict[int, list[tuple[int, int]]] = {}
    for fill, window in sorted(((f, w) for w, f in fills), reverse=True):
        at = bisect_left(room, (fill, -1))
        if at < len(room):
            left, target = room.pop(at)
        else:
            left, target = length, window
            members[target] = []
        members[target].append((window, length - left))
        if left > fill:
            insort(room, (left - fill, target))
    sizes = dict(fills)
    out = []
    for target, inside in members.items():
        total = sum(sizes[w] for w, _ in inside)
        out += [(w, target, base, total) for w, base in inside]
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    windows: int = OPEN_WINDOWS,
    min_cut: int = MIN_CUT,
    merge_rows: int = 4096,
) -> DataFrame:
    """Cut every text into pieces and lay them out in sequences of ``length`` ids.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; then row_id (tells
    repeated rows apart), tokens (ids in the sequence) and padded_length (``length``; a sequence that
    holds a power of two of ids is not padded). A document is its ids and then id 0, so null and
    empty texts have one id. Every row of ``docs`` is packed; an empty table gives no rows; extra
    columns are ignored. A task holds ``windows`` open windows, whatever the data.
    """
    pieces = stage(_pieces(docs, tokenizer, length, windows, min_cut), "pieces")
    last = pieces.filter("is_open")
    fills = last.groupBy("sequence_id").agg(F.max("tokens").alias("fill"))

    def run(batches):
        held: list[tuple[int, int]] = []
        for batch in batches:
            held += zip(*[batch.column(i).to_pylist() for i in range(2)])
            while len(held) >= merge_rows:
                yield merged(held[:merge_rows])
                held = held[merge_rows:]
        if held:
            yield merged(held)

    def merged(some):
        columns = [pa.array(c, pa.int64()) for c in zip(*merge_windows(some, length))]
        return pa.RecordBatch.from_arrays(columns, ["sequence_id", "new_id", "base", "total"])

    # at most one row per task of the first pass; few enough for a few tasks, cut into blocks
    moves = fills.coalesce(8).mapInArrow(run, "sequence_id long, new_id long, base long, total long")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_id", "tokens"]
    closed = pieces.filter("NOT is_open").select(*names)
    moved = last.join(moves, "sequence_id").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("new_id").alias("sequence_id"),
        (F.col("offset") + F.col("base")).alias("offset"), "row_id", F.col("total").alias("tokens"),
    )
    alone = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    padded = F.when(alone, F.col("tokens")).otherwise(F.lit(length).cast("long"))
    return closed.unionByName(moved).withColumn("padded_length", padded)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_packing")
def op1_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir), default_tokenizer())
