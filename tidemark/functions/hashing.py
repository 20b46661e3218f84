"""Seeded hashes: the only source of randomness in the library."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_hash(seed, *cols) -> Column:
    """md5 over ``seed|col|col...``: a reproducible, evenly spread sort key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c) if isinstance(c, str) else c for c in cols]))


def hash_uniform(digest: Column, start: int = 1) -> Column:
    """Uniform number in [0, 1) from eight hex digits of a digest."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def physical_id() -> Column:
    """Id of a row of a parquet file: 128 bits of its file and row index, as 32 hex digits spread evenly."""
    return F.md5(F.concat_ws("|", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")))
