"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass one hashes every text into cells of a blocked Bloom filter and counts the cells; only
cell numbers are shuffled, combined per task first. Cells hit twice or more become bitmaps.
Pass two probes the bitmaps: a text is possibly repeated only if all its cells were hit twice,
and only such rows are shuffled by digest. All others pass straight through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import ascii_lower, column, documents, hot_lookup, packed, unpacked
from tidemark.llm.registry import query
from tidemark.sources.staging import stage

BLOCK = 32768  # bits of one bitmap (4 KiB), the size Spark's bitmap functions work with
CELLS_PER_ROW = 16
MAX_BLOCKS = 32768  # the broadcast bitmaps never exceed 128 MiB; beyond that more rows shuffle, none is lost


def text_digest(text: Column) -> Column:
    """Hex SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _blocks(rows: int, max_blocks: int) -> int:
    blocks = 1
    while blocks * BLOCK < rows * CELLS_PER_ROW and blocks < max_blocks:
        blocks *= 2
    return blocks


def _cells(digest: Column, blocks: int) -> tuple[Column, Column, Column]:
    """(block, first bit, second bit): three independent parts of the 256-bit digest."""

    def part(at: int) -> Column:
        return F.conv(F.substring(digest, at, 8), 16, 10).cast("long")

    return F.pmod(part(1), F.lit(blocks)), F.pmod(part(9), F.lit(BLOCK)), F.pmod(part(17), F.lit(BLOCK))


def repeated_cells(digests: DataFrame, digest: str, blocks: int) -> DataFrame:
    """Pass one: (block, bitmap of the cells hit at least twice); at most ``blocks`` rows of 4 KiB."""
    block, one, two = _cells(F.col(digest), blocks)
    hits = digests.select(block.alias("_block"), F.explode(F.array_distinct(F.array(one, two))).alias("_bit"))
    twice = hits.groupBy("_block", "_bit").agg(F.count(F.lit(1)).alias("_hits")).filter("_hits > 1")
    return twice.groupBy("_block").agg(F.bitmap_construct_agg(F.col("_bit")).alias("_bitmap"))


def maybe_repeated(rows: DataFrame, digest: str, bitmaps: DataFrame, blocks: int) -> DataFrame:
    """Pass two: add ``_maybe``, false only for digests that surely occur once."""
    block, one, two = _cells(F.col(digest), blocks)

    def is_set(bit: Column) -> Column:
        byte = F.hex(F.substring(F.col("_bitmap"), (bit / 8).cast("int") + 1, F.lit(1)))
        return F.getbit(F.conv(byte, 16, 10).cast("long"), F.pmod(bit, F.lit(8)).cast("int")) == 1

    probed = rows.withColumn("_block", block).join(F.broadcast(bitmaps), "_block", "left")
    maybe = F.when(F.col("_bitmap").isNull(), F.lit(False)).otherwise(is_set(one) & is_set(two))
    return probed.withColumn("_maybe", maybe).drop("_block", "_bitmap")


def exact_groups(docs: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. The row with the
    largest doc_id stays (null ids rank lowest); of rows equal in doc_id too, one stays. Extra
    columns are ignored; an empty table gives no rows. The narrow digests are staged once.
    """
    rows = stage(
        docs.select(
            column("doc_id").alias("doc_id"),
            text_digest(column("text")).alias("text_sha256"),
            F.monotonically_increasing_id().alias("_uid"),
        ),
        "digests",
    )
    total = rows.count()
    blocks = _blocks(total, max_blocks)
    bitmaps = stage(repeated_cells(rows, "text_sha256", blocks), "bitmaps")
    probed = maybe_repeated(rows, "text_sha256", bitmaps, blocks)
    alone = probed.filter(~F.col("_maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    maybe = probed.filter("_maybe").drop("_maybe")
    groups = stage(
        maybe.groupBy("text_sha256").agg(
            F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "_uid")).alias("_best")
        ),
        "groups",
    )
    met = hot_lookup(maybe, groups, "text_sha256", "group_size", total)
    return alone.unionByName(
        met.select(
            "doc_id",
            F.col("_best.doc_id").alias("keep_id"),
            "group_size",
            (F.col("_uid") == F.col("_best._uid")).alias("kept"),
            "text_sha256",
        )
    )


def exact_dedup(docs: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged: one per group, as in ``exact_groups``.

    Every task first keeps its own best row per digest, so a group of any size moves at most one
    row per task, and rows that surely occur once do not move at all.
    """
    digest = text_digest(column("text"))
    digests = stage(docs.select(digest.alias("_digest")), "digests")
    blocks = _blocks(digests.count(), max_blocks)
    bitmaps = stage(repeated_cells(digests, "_digest", blocks), "bitmaps")
    rows = docs.select(packed(docs).alias("_row"), digest.alias("_digest"))
    probed = maybe_repeated(rows, "_digest", bitmaps, blocks)
    best = W.partitionBy("_digest").orderBy(F.col("_row").getField("doc_id").desc_nulls_last())
    stays = probed.filter("_maybe").withColumn("_rank", F.row_number().over(best)).filter("_rank = 1")
    out = probed.filter("NOT _maybe").select("_row").unionByName(stays.select("_row"))
    return unpacked(out, "_row", docs.columns)


@query(
    "op3_exact_dedup",
    """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
      row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW g AS (PARTITION BY norm)""",
)
def op3_exact_dedup(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))
