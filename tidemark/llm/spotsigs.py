"""SpotSigs document fingerprints, with DataFrame functions only.

A signature is a common word (an anchor) and the chain of content words that follow it. A document's
fingerprint is its set of signatures. Anchors are the words found in most documents of the corpus.
Fingerprints are compared by Jaccard likeness; a search for pairs partitions the sets by length, so that
only sets of similar length meet, and prunes by rare signatures and length before it compares.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import column, documents
from tidemark.llm.components import components
from tidemark.llm.personal import document_frequency
from tidemark.llm.registry import query
from tidemark.sources.staging import stage

ANCHORS = 256  # the most common words of the corpus
CHAIN = 2  # content words of a signature
REACH = 8  # words after the anchor among which the chain is taken
EXTRA = 4  # one word in so many is an anchor by its hash, so that texts without common words have signatures too
SLICE_ROWS = 2000  # expected documents of one slice of the id order
BINS = 256
MAX_PER_BIN = 256  # so there are at most 65,536 slices of ids, and as many of rows without an id
NULL_SLICES = 65536


def anchor_words(docs: DataFrame, count: int = ANCHORS) -> list[str]:
    """The ``count`` words that occur in most documents, over the whole corpus; ties by the word."""
    common = document_frequency(docs).filter("term <> ''").orderBy(F.desc("df"), "term").limit(count)
    return sorted(r.term for r in common.collect())


def signatures(text: Column, anchors: Sequence[str], chain: int = CHAIN, reach: int = REACH) -> Column:
    """Sorted array of distinct 32-bit signatures; ``text`` is not null.

    Anchors are the common words, and some others by their hash; a chain skips common words. A text without
    any chain has a signature for each word and its successor; one without words has a single one for
    the text, and the empty text has none.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def is_common(w: Column) -> Column:
        return w.isin(list(anchors)) if anchors else F.lit(False)

    def of(all_words: Column) -> Column:
        def at(w: Column, i: Column) -> Column:
            content = F.filter(F.slice(all_words, i + 2, F.lit(reach)), lambda x: ~is_common(x))
            full = F.transform(
                F.array(content), lambda c: F.when(F.size(c) >= chain, F.hash(w, *[c[k] for k in range(chain)]))
            )
            return F.when(is_common(w) | (F.pmod(F.hash(w), F.lit(EXTRA)) == 0), full[0])

        return F.array_sort(F.array_distinct(F.array_compact(F.transform(all_words, at))))

    def plain(all_words: Column) -> Column:
        follow = F.transform(all_words, lambda w, i: F.hash(w, F.coalesce(F.get(all_words, i + 1), F.lit(""))))
        return F.array_sort(F.array_distinct(follow))

    # one-element arrays bind the words and the result once
    both = F.transform(F.array(words), lambda ws: F.struct(ws.alias("words"), of(ws).alias("spots")))
    chosen = F.transform(
        both,
        lambda b: F.when(F.size(b["spots"]) > 0, b["spots"])
        .when(F.size(b["words"]) > 0, plain(b["words"]))
        .when(F.length(text) > 0, F.array(F.hash(text)))
        .otherwise(F.array().cast("array<int>")),
    )
    return chosen[0]


def fingerprint_text(sigs: Column) -> Column:
    """Signatures as hex, eight digits each."""
    digits = F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets; 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        shared / (F.size(a) + F.size(b) - shared).cast("double")
    )


# the order of documents ---------------------------------------------------------------------------


def _slices(docs: DataFrame, rows_per_slice: int) -> Column:
    """Slice of a row, rising with (doc_id, digest), nulls first; ids may be clustered.

    Each of at most 256 quantile bins of the ids is cut evenly, so slices adapt to the ids' distribution.
    """
    doc_id = column("doc_id")
    shares = [i / BINS for i in range(1, BINS)]
    seen = docs.agg(
        F.count(F.lit(1)).alias("n"), F.min(doc_id).alias("low"), F.max(doc_id).alias("high"),
        F.percentile_approx(doc_id, shares, 10_000).alias("cuts"),
    ).first()
    none = F.lit(-NULL_SLICES) + F.conv(F.substring("_tie", 1, 4), 16, 10).cast("int")
    if seen.low is None or seen.n <= rows_per_slice:
        return F.when(F.col("doc_id").isNull(), none).otherwise(F.lit(0))
    per_bin = min(MAX_PER_BIN, max(1, math.ceil(seen.n / (BINS * rows_per_slice))))
    edges = [seen.low, *sorted({c for c in seen.cuts if c > seen.low})]
    widths = [float(b - a) for a, b in zip(edges, [*edges[1:], seen.high + 1])]
    if seen.n <= BINS * rows_per_slice:  # fewer slices than bins: several bins to a slice
        keep = max(1, math.ceil(len(edges) * rows_per_slice / seen.n))
        edges = edges[::keep]
        widths = [float(b - a) for a, b in zip(edges, [*edges[1:], seen.high + 1])]
    lows = F.array(*[F.lit(e) for e in edges])
    spans = F.array(*[F.lit(w) for w in widths])
    bin_ = F.size(F.filter(lows, lambda e: e <= F.col("doc_id")))
    inside = (F.col("doc_id") - F.element_at(lows, bin_)) / F.element_at(spans, bin_) * per_bin
    at = (bin_ - 1) * per_bin + F.least(F.lit(per_bin - 1), F.floor(inside).cast("int"))
    return F.when(F.col("doc_id").isNull(), none).otherwise(at)


def with_next(docs: DataFrame, sigs, rows_per_slice: int = SLICE_ROWS) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs) in ascending doc_id; after the last comes the first.

    Rows without an id come first; rows with one id are ordered by the digest of their texts. Rows are cut
    into slices of the id order; the last row of a slice takes the first row of the next slice, found among
    at most 131,072 slice heads. The texts are shuffled once. ``sigs``: text column -> signatures.
    """
    text = F.coalesce(column("text"), F.lit(""))
    rows = docs.select(column("doc_id").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("_tie", F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.withColumn("_slice", _slices(docs, rows_per_slice))

    heads = rows.groupBy("_slice").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "_tie")).alias("h"))
    heads = stage(heads.select("_slice", F.col("h.doc_id").alias("_head"), F.col("h._tie").alias("_head_tie")), "heads")
    is_head = F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("_tie") == F.col("_head_tie"))
    found = rows.drop("_slice").join(F.broadcast(heads), is_head).groupBy("_slice").agg(F.min("text").alias("text"))
    # at most one row per slice, without texts, in one task
    following = F.lead("_slice").over(W.orderBy("_slice"))
    first = F.min("_slice").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    order = heads.select(F.col("_slice").alias("_of"), F.coalesce(following, first).alias("_slice"))
    found = order.join(found, "_slice").select("_of", F.col("text").alias("_head_text"))
    found = stage(found.withColumn("_head_sigs", sigs(F.col("_head_text"))), "head_texts")

    rows = rows.withColumn("sigs", sigs(F.col("text")))
    ordered = W.partitionBy("_slice").orderBy(F.col("doc_id").asc_nulls_first(), "_tie")
    rows = rows.select("*", F.lead("text").over(ordered).alias("_t"), F.lead("sigs").over(ordered).alias("_s"))
    rows = rows.join(found, (F.col("_slice") == F.col("_of")) & F.col("_t").isNull(), "left")
    return rows.select(
        "doc_id", "text", "sigs",
        F.coalesce("_t", "_head_text").alias("next_text"), F.coalesce("_s", "_head_sigs").alias("next_sigs"),
    )


def edited_text(text: Column, next_text: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(next_text, half))


def fingerprint_edits(docs: DataFrame, anchors: Sequence[str] | None = None, rows_per_slice: int = SLICE_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures).

    Null texts count as empty, repeated rows are reported each, extra columns are ignored, an empty table
    gives no rows. In a table of one row the next document is the row itself.
    """
    anchors = anchor_words(docs) if anchors is None else list(anchors)
    rows = with_next(docs, lambda t: signatures(t, anchors), rows_per_slice)
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "sigs", "next_sigs",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        signatures(F.col("edited"), anchors).alias("edited_sigs"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_text(F.col("sigs")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
    )


# documents with similar sets -----------------------------------------------------------------------


def similar_classes(sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, class_id, links): documents connected by sets of at least this Jaccard likeness.

    ``sets``: doc_id, sigs. Equal sets are one class member from the start, so copies are never compared. The
    others are partitioned by set length: with the ratio of lengths at least ``similarity``, partners lie in
    the same or the next of geometric length classes. Within these, two sets that are similar share one of
    their rarest signatures (all but the last ceil(similarity * n) - 1 of n). In each group that shares
    a rare signature all sets are compared with the first one, the shortest; then all others with each other, but for
    two that the first one took in, as these are in one class already.
    """
    keyed = sets.select("doc_id", "sigs", F.sha2(F.array_join("sigs", ",").cast("binary"), 256).alias("_set"))
    keyed = stage(keyed, "sets")
    distinct = keyed.groupBy("_set").agg(F.first("sigs").alias("sigs"), F.min("doc_id").alias("low"))
    distinct = stage(distinct.withColumn("node", F.xxhash64("_set")), "distinct_sets")
    each = distinct.select("node", F.explode("sigs").alias("sig"))
    counts = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(counts, "sig").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by_rarity"))
    n = F.size("by_rarity")
    prefix = F.slice("by_rarity", F.lit(1), (n - F.ceil(n * similarity) + 1).cast("int"))
    level = F.floor(F.log(n.cast("double")) / F.lit(-math.log(similarity))).cast("long")
    index = ranked.filter(n > 0).select("node", n.alias("n"), level.alias("level"), F.explode(prefix).alias("p"))
    index = index.select("node", "n", F.col("p.sig").alias("sig"), F.explode(F.array("level", F.col("level") + 1)).alias("level"))
    index = stage(index, "rare_signatures")
    left = distinct.select("node", F.col("sigs").alias("a"))
    right = distinct.select(F.col("node").alias("head"), F.col("sigs").alias("b"))

    def alike(close: DataFrame) -> DataFrame:
        met = close.distinct().join(left, "node").join(right, "head").filter(likeness(F.col("a"), F.col("b")) >= similarity)
        return stage(met.select("node", "head"), "similar")

    group = W.partitionBy("sig", "level").orderBy("n", "node").rowsBetween(W.unboundedPreceding, 0)
    first = index.select("sig", "level", "node", "n", F.first("node").over(group).alias("head"), F.first("n").over(group).alias("head_n"))
    first = stage(first.filter("node <> head"), "rare_pairs")
    taken = alike(first.filter(F.col("head_n") >= F.col("n") * similarity - 1e-9).select("node", "head"))
    rows = first.join(taken.withColumn("taken", F.lit(True)), ["node", "head"], "left")
    rows = rows.select("sig", "level", "node", "n", F.coalesce("taken", F.lit(False)).alias("taken"))
    rows = stage(rows, "rare_rows")
    shorter = rows.select("sig", "level", F.col("node").alias("head"), F.col("n").alias("head_n"), F.col("taken").alias("head_taken"))
    close = rows.join(shorter, ["sig", "level"]).filter("head_n < n OR head_n = n AND head < node").filter("NOT (taken AND head_taken)")
    close = close.filter(F.col("head_n") >= F.col("n") * similarity - 1e-9).select("node", "head").distinct()
    edges = taken.unionByName(alike(close.join(taken, ["node", "head"], "left_anti")))
    roots = components(edges.select(F.col("node").alias("u"), F.col("head").alias("v")))
    placed = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = edges.select(F.col("node").alias("e")).unionByName(edges.select(F.col("head").alias("e")))
    links = ends.groupBy(F.col("e").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    ids = placed.groupBy("root").agg(F.min("low").alias("class_id"))
    placed = stage(placed.join(ids, "root").join(links, "node", "left").select("_set", "class_id", F.coalesce("links", F.lit(0)).alias("links")), "set_classes")
    return keyed.select("doc_id", "_set").join(placed, "_set").select("doc_id", "class_id", "links")


@query("op2_spotsigs")
def op2_spotsigs(spark, sf_dir):
    return fingerprint_edits(documents(spark, sf_dir))
