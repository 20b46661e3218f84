"""Queries: the two streaming jobs, run to completion over the supplied files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.encoding import std_params
from tidemark.plans.evaluate import rounded
from tidemark.plans.flow import FLOW, FLOW_SCHEMA, flow, flow_path, training
from tidemark.plans.registry import Z_SQL, query, with_flow
from tidemark.streaming.yearly import stream_drift_counts, stream_score

NUM = list(FLOW.num)


@query(
    "stream_drift_counts",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def drift_counts(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, because a stream takes a folder or a pattern but not the name of one file
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    stamped = source.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = stream_drift_counts(stamped, "ts", "event_type")
    return counts.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(
    "stream_score",
    with_flow(Z_SQL.replace("FROM test CROSS JOIN zp", "FROM flow AS test CROSS JOIN zp") + " SELECT row_key, year, round(score, 6) AS score FROM z"),
)
def score_arrivals(spark, sf_dir):
    params = std_params(training(flow(spark, sf_dir)), NUM)
    arriving = spark.readStream.schema(FLOW_SCHEMA).parquet(flow_path(spark, sf_dir))
    scored = stream_score(arriving.select("row_key", "year", *NUM), NUM, params)
    return rounded(scored.select("row_key", "year", "score"), "score")
