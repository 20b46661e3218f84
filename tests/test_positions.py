"""Positions come from places in sorted slices: each row moves once."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordering
from tidemark.operators.sampling import shuffle_rows


@pytest.mark.parametrize("by", [[], ["g"]])
def test_positions_move_each_row_once(spark, by, monkeypatch):
    """Many slices, a third of the rows equal, null groups and null ids: positions follow the hashes, and copies their ids."""
    monkeypatch.setattr(ordering, "SLICE_ROWS", 20, raising=False)
    key = F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string"))
    copy = F.when(F.col("id") != 5, F.format_string("%016x", F.col("id")))
    group = F.when(F.col("id") % 4 != 2, F.col("id") % 4 % 2)
    df = spark.range(600).select(key.alias("row_key"), copy.alias("copy_id"), group.alias("g"))
    placed = shuffle_rows(df, 9, by)
    text = placed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text and "Window" not in text
    groups = {}
    for r in placed.collect():
        h = hashlib.md5(f"9|{r['row_key']}".encode()).hexdigest()
        groups.setdefault(r["g"] if by else 0, []).append((r["position"], (r["copy_id"] is not None, h, r["copy_id"] or "")))
    assert sum(map(len, groups.values())) == 600 and len(groups) == (3 if by else 1)
    for found in groups.values():
        found.sort()
        assert [p for p, _ in found] == list(range(1, len(found) + 1))
        assert [k for _, k in found] == sorted(k for _, k in found)
