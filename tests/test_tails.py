"""Tails are looked up in the row: rows do not move to be scored."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import tails


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, n=400):
    """Numbers with nulls and hot values, ids of which some repeat and some are null."""
    ids = F.when(F.col("id") % 50 == 7, None).when(F.col("id") % 40 == 3, "twice").otherwise(F.col("id").cast("string"))
    x = F.when(F.col("id") % 90 != 1, (F.col("id") * 37 % 101).cast("double"))
    return spark.range(n).select(ids.alias("copy_id"), x.alias("x"), (F.col("id") % 7).cast("double").alias("y"), F.concat(F.lit("c"), F.col("id") % 5).alias("c"))


@pytest.mark.parametrize("rule", ["ecod", "copod"])
def test_rows_do_not_move_to_be_scored(spark, rule):
    df = rows(spark).withColumn("copy_id", F.monotonically_increasing_id().cast("string"))
    scored = tails.TailModel(df, ["x", "y"], ["c"]).score(df, rule)
    assert scored.count() == 400
    assert "hashpartitioning" not in plan(scored)


@pytest.mark.parametrize("many", [10, 10_000])
def test_rows_with_one_id_share_the_sum_of_their_numbers(spark, many, monkeypatch):
    """Whether the values are broadcast or shuffled; alone, every row has the score of its own numbers."""
    monkeypatch.setattr(tails, "MANY_VALUES", many, raising=False)
    df = rows(spark).withColumn("k", F.monotonically_increasing_id())
    model = tails.TailModel(df, ["x", "y"])
    own = {r["k"]: r["score"] for r in model.score(df, "ecod", ["k"]).collect()}
    of = {r["k"]: r["copy_id"] for r in df.select("k", "copy_id").collect()}
    got = {r["k"]: r["score"] for r in model.score(df, "ecod").collect()}
    sums = {}
    for k, i in of.items():
        sums[i] = None if own[k] is None or sums.get(i, 0.0) is None else sums.get(i, 0.0) + own[k]
    assert set(got) == set(of) and sum(v is None for v in got.values()) > 4
    for k, i in of.items():
        assert got[k] == (None if sums[i] is None else pytest.approx(sums[i]))
