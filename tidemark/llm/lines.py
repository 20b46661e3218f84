"""Line dedup: range-partitioned line hashes, first occurrences streamed, bitmaps returned.

Every long line of a text becomes a narrow row (128-bit hash, document, line number). The rows are
range-partitioned by hash and document and sorted by hash, document (largest first) and line. One
pass over a sorted partition meets the document that keeps a line first and passes on the lines of
all others. As documents are part of the range, a line that a third of the corpus holds lies in many
partitions; what a partition can't decide alone, its first and last hash, is decided by summaries, two
rows a partition. The result is a compressed bitmap of kept lines per document, never text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import column, documents, small_batches
from tidemark.llm.registry import query
from tidemark.sources.staging import stage

LEAST_CHARS = 20  # code points of a line that counts
LEAST_DOCS = 3  # documents that must hold it
NO_ID = -(2**63)  # order key of a null id
SPACE = b" \t\n\x0b\x0c\r"

ROWS = ["h1", "h2", "doc", "tie", "line"]
LINE_ROWS = "h1 long, h2 long, doc long, tie long, line long"
DROPPED, PENDING, SUMMARY = 0, 1, 2


def _long_keys(text: bytes, least: int) -> tuple[list[int], list[bytes]]:
    """Numbers and keys of the lines of ``least`` code points: stripped, A-Z lower-cased (bytes: other letters stay)."""
    at, keys = [], []
    for i, line in enumerate(text.lower().split(b"\n")):
        key = line.strip(SPACE)
        if len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least):
            at.append(i)
            keys.append(key)
    return at, keys


def _identified(docs: DataFrame) -> DataFrame:
    """(doc, tie, _text): the id as an order key, a hash that tells rows of one id apart, the text."""
    text = F.coalesce(column("text"), F.lit(""))
    doc = F.coalesce(column("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("tie"), text.alias("_text"))


def line_rows(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, doc, tie, line): a row per long line, and one per text without hash whose ``line`` is the number of lines."""

    def run(batches):
        for batch in batches:
            doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            counts, sizes, lines, digests = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                at, keys = _long_keys(text, least_chars)
                counts.append(text.count(b"\n") + 1)
                sizes.append(len(at))
                lines += at
                digests += map(xxhash.xxh3_128_digest, keys)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            of = np.repeat(np.arange(len(sizes)), sizes)
            none = pa.nulls(len(doc), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *map(pa.array, (doc, tie, np.array(counts, np.int64)))], ROWS)
            found = (np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), doc[of], tie[of], np.array(lines, np.int64))
            yield pa.RecordBatch.from_arrays([*map(pa.array, found)], ROWS)

    small_batches(docs.sparkSession)
    return _identified(docs).mapInArrow(run, LINE_ROWS)


class FirstOccurrences:
    """State of one pass over a sorted partition: the hash that is open, its first document, the documents seen.

    ``feed`` takes sorted columns h1, h2, doc, tie, line and gives (kind, h1, h2, doc, tie, line) columns: lines
    to drop, lines whose hash began in an earlier partition (pending), and summaries (doc: the largest document,
    line: the documents met) of the partition's first and last hash. Lines of at most ``least_docs - 2``
    documents wait in memory.
    """

    def __init__(self, least_docs: int):
        self.least = least_docs
        self.open = None  # (h1, h2), first document, documents, last document, is it the partition's first hash
        self.waiting: list[tuple] = []

    def _emit(self, out, kind, columns):
        if len(columns[0]):
            out.append((np.full(len(columns[0]), kind, np.int32), *columns))

    def _summary(self, out):
        key, top, docs, _, _ = self.open
        self._emit(out, SUMMARY, [np.array([x], np.int64) for x in (*key, top, 0, docs)])

    def feed(self, h1, h2, doc, tie, line) -> list[tuple]:
        out, n = [], len(h1)
        if not n:
            return out
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        other = np.append(True, doc[1:] != doc[:-1])
        begins_open = self.open is not None and self.open[0] == (h1[0], h2[0])
        if begins_open:
            new[0], other[0] = False, doc[0] != self.open[3]
        elif self.open is not None:
            self._close(out)
        run = np.cumsum(new) - (0 if begins_open else 1)
        starts = np.flatnonzero(new)
        top = doc[starts]
        docs = np.bincount(run, weights=new | other).astype(np.int64)
        if begins_open:
            top = np.append(self.open[1], top)
            docs[0] += self.open[2]
        first = self.open is None or (begins_open and self.open[4])  # is run 0 the partition's first hash
        columns = (h1, h2, doc, tie, line)
        behind = doc != top[run]
        last = int(run[-1])
        if first:
            mine = run == 0  # its largest document may lie in an earlier partition
            self._emit(out, PENDING, [c[mine] for c in columns])
        ready = behind & (docs[run] >= self.least)
        ready[run == 0] &= not first
        if begins_open and docs[0] >= self.least:
            for rows in self.waiting:
                self._emit(out, DROPPED, rows)
            self.waiting = []
        self._emit(out, DROPPED, [c[ready] for c in columns])
        if last > 0:  # the open hash of before is complete
            if begins_open:
                self.waiting = []
            if first:
                self.open = ((h1[0], h2[0]), top[0], docs[0], None, True)
                self._summary(out)
        waits = behind & (run == last) & ~ready
        if docs[last] < self.least and waits.any() and not (first and last == 0):
            self.waiting.append([c[waits] for c in columns])
        self.open = ((h1[-1], h2[-1]), top[last], docs[last], doc[-1], first and last == 0)
        return out

    def _close(self, out):
        """The open hash ended with the batch: its waiting lines stay."""
        if self.open[4]:
            self._summary(out)
        self.waiting = []

    def finish(self) -> list[tuple]:
        """The last hash may go on in the next partition."""
        out = []
        if self.open is not None:
            for rows in self.waiting:
                self._emit(out, PENDING, rows)
            self._summary(out)
        return out


def dropped_lines(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, tie, line) of every line to drop; ``rows`` as ``line_rows`` gives them, staged."""
    names = ["kind", *ROWS]

    def run(batches):
        state = FirstOccurrences(least_docs)
        for batch in batches:
            for columns in state.feed(*[batch.column(i).to_numpy() for i in range(5)]):
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names)
        for columns in state.finish():
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names)

    order = ("h1", "h2", F.desc("doc"))
    ranged = rows.filter("h1 IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order, "tie", "line")
    met = stage(ranged.mapInArrow(run, f"kind int, {LINE_ROWS}"), "line_occurrences")
    ends = met.filter(F.col("kind") == SUMMARY).groupBy("h1", "h2")
    ends = ends.agg(F.max("doc").alias("top"), F.sum("line").alias("docs")).filter(F.col("docs") >= least_docs)
    pending = met.filter(F.col("kind") == PENDING).join(F.broadcast(ends), ["h1", "h2"])  # two rows a partition at most
    done = met.filter(F.col("kind") == DROPPED).select("doc", "tie", "line")
    return done.unionByName(pending.filter("doc < top").select("doc", "tie", "line"))


def pack_bitmap(n_lines: int, dropped) -> bytes:
    """Compressed bits, line 0 first; 1 if the line stays."""
    keep = np.ones(n_lines, np.uint8)
    keep[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bitmap(packed: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, tie, n_lines, n_dropped, keep): a bitmap of the lines that stay, one row per distinct (id, text).

    Texts are split at newlines; null and empty texts are one empty line. Lines count as equal if they are after
    stripping ASCII white space and lower-casing A-Z; ``least_chars`` code points make them long enough. A line found
    in ``least_docs`` documents stays only in the largest doc_id holding it, there at every place. ``doc`` is the id, null ids
    count as one document with the smallest long; rows with one id are one document, rows equal in text too
    share a bitmap. ``keep`` is null where no line goes. Extra columns are ignored; an empty table gives no rows.
    """
    rows = stage(line_rows(docs, least_chars), "lines")
    whole = rows.filter("h1 IS NULL").select("doc", "tie", F.col("line").alias("n"), F.lit(None).cast("long").alias("line"))
    gone = dropped_lines(rows, least_docs).select("doc", "tie", F.lit(None).cast("long").alias("n"), "line")
    each = whole.unionByName(gone).groupBy("doc", "tie").agg(F.max("n").alias("n_lines"), F.collect_set("line").alias("gone"))

    def run(batches):
        for batch in batches:
            n = batch.column(2).to_pylist()
            gone = [np.asarray(x) for x in batch.column(3).to_pylist()]
            keep = pa.array([pack_bitmap(a, b) if len(b) else None for a, b in zip(n, gone)], pa.binary())
            sizes = pa.array([len(b) for b in gone], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, keep], ["doc", "tie", "n_lines", "n_dropped", "keep"])

    return each.mapInArrow(run, "doc long, tie long, n_lines long, n_dropped long, keep binary")


def kept_text(text: bytes, keep: bytes | None) -> bytes:
    if keep is None:
        return text
    lines = text.split(b"\n")
    return b"\n".join([line for line, stays in zip(lines, unpack_bitmap(keep, len(lines))) if stays])


def kept_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256), one row per row of ``docs``: its bitmap applied to its text."""

    def run(batches):
        for batch in batches:
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            pairs = zip(texts, batch.column(4).to_pylist())
            digests = [hashlib.sha256(kept_text(t, k)).hexdigest() for t, k in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests)], names)

    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    met = _identified(docs).join(bitmaps, ["doc", "tie"])
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return met.select(doc_id, "n_lines", "n_dropped", "_text", "keep").mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    )


LINES_SQL = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(k.doc_id < g.top, FALSE) AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@query("op11_lines", LINES_SQL)
def op11_lines(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return kept_digests(docs, keep_bitmaps(docs))
