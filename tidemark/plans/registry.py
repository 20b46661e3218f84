"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows (none: rows are only counted)."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# the rule of the bins, stated again: edge i is 1.1^i - 1, the outer two are widened by 0.01
EDGES = (
    "list_transform(range(0, 233), lambda i: pow(1.1::DOUBLE, i) - 1 + CASE i WHEN 0 THEN -0.01 WHEN 232 THEN 0.01 ELSE 0 END)"
)

FLOW_SQL = f"""
edges AS (SELECT {EDGES} AS e),
flow0 AS (
  SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT), CAST(floor(l_quantity * 100 + 0.5) AS BIGINT),
           CAST(floor(l_discount * 100 + 0.5) AS BIGINT), CAST(floor(l_tax * 100 + 0.5) AS BIGINT),
           l_returnflag, l_linestatus, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS row_key,
    CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
    CAST(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN -1 WHEN 'R' THEN -2 END AS INTEGER) AS raw_label,
    l_linestatus AS cat_status, p_type AS cat_type,
    'c0' || (len(list_filter(e, lambda b: b < l_extendedprice)) - 1) AS cat_price,
    'c2' || (len(list_filter(e, lambda b: b < l_quantity)) - 1) AS cat_quantity,
    l_quantity AS num_quantity, l_extendedprice AS num_price, l_discount AS num_discount, l_tax AS num_tax
  FROM lineitem JOIN part ON l_partkey = p_partkey CROSS JOIN edges),
flow1 AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY year, raw_label ORDER BY md5('10|' || row_key))
      <= round_even(CAST(0.1 AS DOUBLE) * count(*) OVER (PARTITION BY year, raw_label), 0)
    THEN 'valid' ELSE 'train' END AS part,
    CAST(CASE WHEN raw_label = 1 THEN 0 ELSE 1 END AS INTEGER) AS label
  FROM flow0),
flow AS (
  SELECT *, CASE WHEN year BETWEEN 1995 AND 1998 THEN CASE part WHEN 'valid' THEN 'IID' ELSE 'TRAIN' END
                 WHEN year <= 2000 THEN 'NEAR' ELSE 'FAR' END AS split
  FROM flow1),
train AS (SELECT * FROM flow WHERE split = 'TRAIN' AND label = 0),
test AS (SELECT * FROM flow WHERE split IN ('IID', 'NEAR', 'FAR'))"""


def with_flow(body: str) -> str:
    """SQL over the flow table; ``body`` may start with further named queries (", x AS (...)")."""
    return f"WITH {FLOW_SQL}\n{body}"


def metrics_sql(by: str) -> str:
    """Named query ``wide`` with the curve metrics of ``scored(by..., label, score)``."""
    return f""",
points AS (SELECT {by}, score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY {by}, score),
cum AS (
  SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER u AS tp_in, sum(neg) OVER u AS fp_in,
    sum(pos) OVER g AS n_pos, sum(neg) OVER g AS n_neg
  FROM points WINDOW g AS (PARTITION BY {by}), d AS (PARTITION BY {by} ORDER BY score DESC),
    u AS (PARTITION BY {by} ORDER BY score)),
pr AS (
  SELECT *, tp / (tp + fp) AS p_out, tp / nullif(n_pos, 0) AS r_out,
    fp_in / (tp_in + fp_in) AS p_in, fp_in / nullif(n_neg, 0) AS r_in FROM cum),
steps AS (
  SELECT *, coalesce(lag(p_out) OVER d, 1.0) AS p_out0, coalesce(lag(r_out) OVER d, 0.0) AS r_out0,
    coalesce(lag(p_in) OVER u, 1.0) AS p_in0, coalesce(lag(r_in) OVER u, 0.0) AS r_in0
  FROM pr WINDOW d AS (PARTITION BY {by} ORDER BY score DESC), u AS (PARTITION BY {by} ORDER BY score)),
wide AS (
  SELECT {by},
    CAST(sum(pos * (tp_in - pos + fp_in - neg + (pos + neg + 1) / 2.0)) - max(n_pos) * (max(n_pos) + 1) / 2.0 AS DOUBLE)
      / nullif(CAST(max(n_pos) * max(n_neg) AS DOUBLE), 0) AS roc_auc,
    sum((r_out - r_out0) * (p_out + p_out0) / 2) AS pr_auc_outlier,
    sum((r_in - r_in0) * (p_in + p_in0) / 2) AS pr_auc_inlier,
    CASE WHEN max(n_pos) > 0 THEN max(CASE WHEN p_out + r_out > 0 THEN 2 * p_out * r_out / (p_out + r_out) ELSE 0 END)
      END AS max_f1_outlier,
    CASE WHEN max(n_neg) > 0 THEN max(CASE WHEN p_in + r_in > 0 THEN 2 * p_in * r_in / (p_in + r_in) ELSE 0 END)
      END AS max_f1_inlier
  FROM steps GROUP BY {by})"""


METRIC_NAMES = ("roc_auc", "pr_auc_outlier", "pr_auc_inlier", "max_f1_outlier", "max_f1_inlier")


def long_metrics(by: str) -> str:
    """Named query ``metrics(by..., metric, value)`` over ``wide``."""
    rows = " UNION ALL ".join(f"SELECT {by}, '{m}' AS metric, {m} AS value FROM wide" for m in METRIC_NAMES)
    return f", metrics AS ({rows})"


# largest absolute z-score of the four numeric features, fitted on the training inliers
Z_SQL = """,
zp AS (SELECT
  avg(num_quantity) m1, stddev_pop(num_quantity) s1, avg(num_price) m2, stddev_pop(num_price) s2,
  avg(num_discount) m3, stddev_pop(num_discount) s3, avg(num_tax) m4, stddev_pop(num_tax) s4 FROM train),
z AS (SELECT test.*, greatest(abs((num_quantity - m1) / s1), abs((num_price - m2) / s2),
  abs((num_discount - m3) / s3), abs((num_tax - m4) / s4)) AS score FROM test CROSS JOIN zp)"""
