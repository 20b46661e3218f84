"""Streams: day-by-day category counts, and scoring of rows as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.encoding import max_abs_z
from tidemark.sources.staging import new_path, stage


def _folders(spark: SparkSession, name: str, root: str | None) -> tuple[str, str]:
    """Folders of results and of the checkpoint: below ``root``, or new ones that no later run finds."""
    root = root.rstrip("/") if root else new_path(spark, name)
    return f"{root}/{name}", f"{root}/checkpoint"


def stream_drift_counts(
    events: DataFrame, time: str, category: str, delay: str = "1 day", root: str | None = None
) -> DataFrame:
    """Category counts per day from a stream, run until the input is used up.

    Rows later than the watermark are dropped by the state store, which only keeps open
    days. Each micro-batch appends its changed counts; the last batch of a day wins. A run with the ``root`` of an
    earlier one, also of one that was killed, goes on where that ended and returns the counts of both.
    """
    spark = events.sparkSession
    counts = (
        events.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day").alias("w"), category)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("day"), category, "n")
    )
    path, log = _folders(spark, "stream_counts", root)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    query = (
        counts.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", log)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    changes = spark.read.parquet(path)
    return changes.groupBy("day", category).agg(F.max_by("n", "batch").alias("n"))


def batch_drift_counts(events: DataFrame, time: str, category: str) -> DataFrame:
    day = F.window(time, "1 day")["start"].alias("day")
    return events.groupBy(day, category).agg(F.count(F.lit(1)).alias("n"))


def stream_score(rows: DataFrame, columns: Sequence[str], params: DataFrame, root: str | None = None) -> DataFrame:
    """Score arriving rows with fixed parameters; returns the scored table.

    The parameters are computed once, before the stream starts; no micro-batch fits anything. ``root`` as for
    ``stream_drift_counts``.
    """
    spark = rows.sparkSession
    params = stage(params, "stream_params")
    path, log = _folders(spark, "stream_scores", root)

    def score(batch: DataFrame, number: int) -> None:
        max_abs_z(batch, columns, params).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        rows.writeStream.foreachBatch(score)
        .option("checkpointLocation", log)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(path).drop("batch")
