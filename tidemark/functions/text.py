"""Row sentences, tokens and raw-line parsing as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Special tokens, in id order 0, 1, 2.
UNK, PAD, MASK = "[UNK]", "[PAD]", "[MASK]"
SPECIALS = (UNK, PAD, MASK)
UNK_ID, PAD_ID, MASK_ID = 0, 1, 2

RAW_FIELDS = 18

BLANKS = r"(?U)\s+"  # any run of Unicode white space


def row_to_sentence(columns: Sequence[str]) -> Column:
    """All columns joined by spaces; NULL becomes the word ``nan``."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def pad_to_block(ids: Column, block: int) -> Column:
    """Cut or pad an id array to exactly ``block`` ids."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(PAD_ID), block)), 1, block)


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda i: (i != PAD_ID).cast("int"))


def split_fields(line: Column) -> Column:
    """First 18 tab-separated fields of a raw line."""
    return F.slice(F.split(line, "\t"), 1, RAW_FIELDS)


def concat_timestamp(year: Column, month: Column, clock: Column) -> Column:
    return F.concat_ws("_", year, month, clock)
