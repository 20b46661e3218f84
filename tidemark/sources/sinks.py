"""Partitioned writes of yearly tables, metrics, scores and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.rows import cast_all_string
from tidemark.operators.sampling import mark_holdout


def sink_halfyear(df: DataFrame, path: str, single_years: tuple[int, ...] = (2006,)) -> None:
    """All columns as text, under year and half (0 for a year kept in one piece)."""
    half = F.when(F.col("year").isin(*single_years), 0).when(F.col("month") <= 6, 1).otherwise(2)
    out = cast_all_string(df).withColumn("half", half)
    out.hint("rebalance", "year", "half").write.mode("overwrite").partitionBy("year", "half").parquet(path)


def sink_train_test(df: DataFrame, path: str, share: float = 0.1, strata=("year", "label"), key="row_key", copy="copy_id") -> None:
    """Stratified hold-out written as ``part=train`` and ``part=valid`` of every year."""
    marked = mark_holdout(df, share, list(strata), key=key, copy=copy)
    marked.hint("rebalance", "year", "part").write.mode("overwrite").partitionBy("year", "part").parquet(path)


def _replace_run(df: DataFrame, path: str, run: str) -> None:
    """Write the rows under run=<run>; a rerun replaces its own folder and leaves those of other runs."""
    tagged = df.withColumn("run", F.lit(run))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)


def sink_metrics(metrics: DataFrame, path: str, run: str) -> None:
    """Metric rows of one run; other runs stay, the same run replaces itself."""
    _replace_run(metrics, path, run)


def sink_scores(scored: DataFrame, path: str, run: str) -> None:
    """(row id, label, score) rows of one run, with the rule of ``sink_metrics``."""
    _replace_run(scored, path, run)


def sink_vocab(vocab: DataFrame, path: str) -> None:
    """One tokenizer-style JSON document; a vocabulary has a bounded size."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "id"))))
    model = F.struct(F.lit("WordLevel").alias("type"), F.lit("[UNK]").alias("unk_token"), entries.alias("vocab"))
    vocab.agg(F.to_json(F.struct(model.alias("model"))).alias("value")).write.mode("overwrite").text(path)
