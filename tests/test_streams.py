"""Streams that are killed and run again with the same folder."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.operators.encoding import max_abs_z, std_params
from tidemark.streaming.yearly import batch_drift_counts, stream_drift_counts, stream_score

SCHEMA = "ts timestamp, kind string, x double"


def day(n):
    return datetime.datetime(2020, 1, n, 12)


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def arriving(spark, folder, poison=None):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    if poison:
        broken = F.when(F.col("kind") == poison, F.raise_error(F.lit("lost"))).otherwise(F.col("x"))
        rows = rows.withColumn("x", broken.cast("double")).filter("x IS NOT NULL")
    return rows


def test_a_killed_run_goes_on_and_equals_the_batch(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, folder, "1", [(day(1), "a", 1.0), (day(1), "b", 2.0), (day(2), "a", 3.0)])
    write(spark, folder, "2", [(day(2), "a", 4.0), (day(2), "poison", 5.0), (day(3), "b", 6.0)])
    with pytest.raises(StreamingQueryException):
        stream_drift_counts(arriving(spark, folder, "poison"), "ts", "kind", root=root)
    write(spark, folder, "3", [(day(3), "b", 7.0), (day(4), "c", 8.0)])
    got = stream_drift_counts(arriving(spark, folder), "ts", "kind", root=root)
    want = batch_drift_counts(spark.read.schema(SCHEMA).parquet(f"{folder}/*"), "ts", "kind")
    assert sorted(map(tuple, got.select("day", "kind", "n").collect())) == sorted(map(tuple, want.collect()))
    # a row more than the delay behind all that was seen is dropped, one within it counts
    write(spark, folder, "4", [(day(1), "late", 9.0), (day(4), "c", 9.0)])
    again = {(r.day.day, r.kind): r.n for r in stream_drift_counts(arriving(spark, folder), "ts", "kind", root=root).collect()}
    assert again[4, "c"] == 2 and (1, "late") not in again and len(again) == got.count()


def test_a_killed_scoring_run_scores_every_row_once(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, folder, "1", [(day(1), "a", 1.0), (day(1), "b", 2.0)])
    write(spark, folder, "2", [(day(2), "poison", 5.0)])
    params = std_params(spark.read.schema(SCHEMA).parquet(f"{folder}/1"), ["x"])
    with pytest.raises(StreamingQueryException):
        stream_score(arriving(spark, folder, "poison"), ["x"], params, root=root)
    got = stream_score(arriving(spark, folder), ["x"], params, root=root)
    want = max_abs_z(spark.read.schema(SCHEMA).parquet(f"{folder}/*"), ["x"], params)
    assert sorted(map(tuple, got.select("kind", "score").collect())) == sorted(map(tuple, want.select("kind", "score").collect()))
