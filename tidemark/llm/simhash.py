"""SimHash near-dedup with covering locality-sensitive hashing.

Fifteen bit masks are built so that any two fingerprints that differ in at most three bits are
equal under one of them: position i carries a vector m(i) of four bits, and the mask of a vector
v keeps the positions where m(i) . v is odd. Three differing positions span at most three
dimensions, so some v is orthogonal to all of them, and under its mask they vanish. A bucket with
too many fingerprints is masked again over its free bits. Each level at least halves the free bits,
and f free bits allow 2^f fingerprints, so every bucket ends small: no pair is lost to a cap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.common import column, documents, hot_lookup, packed, small_batches, unpacked
from tidemark.llm.components import components
from tidemark.llm.registry import query
from tidemark.sources.staging import stage

RADIUS = 3
WIDTH = 3  # words of a shingle
BUCKET = 4096  # fingerprints compared with each other in one block; larger buckets are masked again
SLICE = 1 << 16  # hashes whose bits are added up at once


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """64-bit SimHash, as a signed number: a bit is 1 if set in over half of the shingles' hashes."""
    words = (text or b"").lower().split()  # bytes: lower-cases A-Z, splits at space and 09-0D
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
    elif width > 1:
        words = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., fp): one row per row of ``docs``; null texts count as empty."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            values = pa.array([fingerprint(t, width) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names)

    small_batches(docs.sparkSession)
    names = ["doc_id", *keep, "fp"]
    source = docs.select(*[column(c).alias(c) for c in names[:-1]], column("text").alias("text"))
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in names[:-1])
    return source.mapInArrow(run, f"{kinds}, fp long")


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks within the set bits of ``free``; fingerprints at most ``radius`` apart there agree under one."""
    positions = [i for i in range(64) if free >> i & 1]
    size = 1 << (radius + 1)
    masks = set()
    for v in range(1, size):
        kept = [i for n, i in enumerate(positions) if ((1 + n % (size - 1)) & v).bit_count() % 2]
        masks.add(sum(1 << i for i in kept))
    return sorted(masks)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _level(rows: DataFrame) -> DataFrame:
    """(fixed, key, fp) -> the same fingerprints under every covering mask of their free bits."""

    def run(batches):
        known = {}
        for batch in batches:
            fixed, key, fp = (batch.column(i).to_numpy() for i in range(3))
            out = [[], [], []]
            for value in np.unique(fixed):
                old = int(value) & (2**64 - 1)
                if old not in known:
                    known[old] = covering_masks(~old & (2**64 - 1))
                rows_ = fixed == value
                for mask in known[old]:
                    out[0].append(np.full(int(rows_.sum()), _signed(old | mask)))
                    parent = key[rows_].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(mask % (2**61 - 1))
                    kept = (fp[rows_].view(np.uint64) & np.uint64(mask)) + parent
                    out[1].append(_mix(kept).view(np.int64))
                    out[2].append(fp[rows_])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["fixed", "key", "fp"])

    return rows.mapInArrow(run, "fixed long, key long, fp long")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def link_bucket(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Tree edges of the graph that links values at most ``radius`` bits apart."""
    rest, edges = np.unique(values.view(np.uint64)), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            edges += [(at, x) for x in rest[near]]
            front += list(rest[near])
            rest = rest[~near]
    return edges


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``) that connect all pairs within ``radius``.

    Output is at most one edge per fingerprint and bucket; pairs inside a bucket are compared in
    numpy and never become rows.
    """
    if radius != RADIUS:
        raise ValueError("the masks are built for radius 3")
    edges = None
    rows = fps.select(F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("key"), "fp")

    def run(batches):
        for batch in batches:
            u, v = [], []
            for values in batch.column(0):
                for a, b in link_bucket(values.values.to_numpy()):
                    u.append(a)
                    v.append(b)
            ends = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)]
            yield pa.RecordBatch.from_arrays(ends, ["u", "v"])

    while rows is not None:
        rows = stage(_level(rows), "buckets")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fixed").alias("f")).filter("n > 1")
        sizes = stage(sizes, "sizes")
        # with at most 12 free bits a bucket has 4096 values at most, whatever the data
        large = (F.col("n") > bucket) & (F.bit_count(F.bitwise_not("f")) > 12)
        small = rows.join(sizes.filter(~large).select("key"), "key").select("key", "fp")
        grouped = small.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
        found = grouped.mapInArrow(run, "u long, v long")
        edges = found if edges is None else edges.unionByName(found)
        more = sizes.filter(large)
        rows = None if more.isEmpty() else rows.join(more.select("key"), "key").select("fixed", "key", "fp")
    return edges


def fingerprint_components(pairs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Add component_id, the smallest doc_id reachable over links of fingerprints, and ``root``, its key.

    ``pairs`` (doc_id, fp, ...) should be staged: it is read three times. Null ids are never the
    smallest; a component of null ids only has a null component_id.
    """
    total = pairs.count()
    fps = stage(pairs.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "fps")
    roots = components(fingerprint_links(fps.select("fp"), radius, bucket))
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = stage(placed, "placed")
    joined = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("of_root"))
    table = hot_lookup(placed, stage(joined, "roots"), "root", "of_root", total)
    table = stage(table.select("fp", "n", "root", "component_id"), "members")
    return hot_lookup(pairs, table, "fp", "n", total).drop("n")


def simhash_groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows are kept; extra
    columns are ignored; an empty table gives no rows.
    """
    out = fingerprint_components(stage(fingerprints(docs), "fingerprints"), bucket=bucket)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row of ``docs`` per component, columns unchanged: the one with the smallest doc_id.

    Null ids rank last; of rows with the same id the smallest text hash decides, and of rows equal
    in both one stays.
    """
    text_hash = F.xxhash64(F.coalesce(column("text"), F.lit("")))
    pairs = stage(fingerprints(docs.withColumn("_h", text_hash), keep=("_h",)), "fingerprints")
    members = fingerprint_components(pairs, bucket=bucket)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")
    best = members.groupBy("root").agg(F.min(order).alias("b")).select("b.doc_id", "b._h")
    heads = stage(best, "heads").select(F.col("doc_id").alias("_head"), F.col("_h").alias("_head_h"))
    rows = docs.select(packed(docs).alias("_row"), column("doc_id").alias("_id"), text_hash.alias("_h"))
    is_head = F.col("_id").eqNullSafe(F.col("_head")) & (F.col("_h") == F.col("_head_h"))
    stays = rows.join(heads, is_head, "left_semi")
    copies = pairs.withColumnRenamed("doc_id", "_id").join(heads, is_head, "left_semi").groupBy("_id", "_h").count()
    if not copies.filter("count > 1").isEmpty():
        first = W.partitionBy("_id", "_h").orderBy("_id")
        stays = stays.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
    return unpacked(stays, "_row", docs.columns)


@query("op7_simhash")
def op7_simhash(spark, sf_dir):
    return simhash_groups(documents(spark, sf_dir))
