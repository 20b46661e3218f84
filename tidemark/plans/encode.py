"""Queries: dictionaries, one-hot blocks, scalers and quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import encoding
from tidemark.plans.evaluate import rounded
from tidemark.plans.flow import FLOW, PROTOCOL, flow, testing, training
from tidemark.plans.registry import query, with_flow

NUM, CAT = list(FLOW.num), list(FLOW.cat)

TRAIN_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM train" for c in NUM) + ")"


def dictionary_sql(source: str, columns=CAT) -> str:
    cells = " UNION ".join(f"SELECT '{c}' AS feature, {c} AS category FROM {source}" for c in columns)
    return f", dict AS (SELECT feature, category, row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS idx FROM ({cells}))"


@query(
    "std_params",
    with_flow(TRAIN_LONG + """ SELECT feature, round(avg(value), 6) AS mean,
  round(CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END, 6) AS std FROM long GROUP BY 1"""),
)
def std_params(spark, sf_dir):
    return rounded(encoding.std_params(training(flow(spark, sf_dir)), NUM), "mean", "std")


ROBUST_SQL = TRAIN_LONG + """,
rp AS (SELECT feature, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS spread
  FROM long GROUP BY 1),
robust AS (SELECT feature, median, CASE WHEN spread = 0 THEN 1 ELSE spread END AS iqr FROM rp)"""


@query("robust_params", with_flow(ROBUST_SQL + " SELECT feature, round(median, 6) AS median, round(iqr, 6) AS iqr FROM robust"))
def robust_params(spark, sf_dir):
    return rounded(encoding.robust_params(training(flow(spark, sf_dir)), NUM), "median", "iqr")


def scaled_sql(params: str, centre: str, spread: str) -> str:
    columns = ", ".join(
        f"round((t.{c} - (SELECT {centre} FROM {params} WHERE feature = '{c}')) / (SELECT {spread} FROM {params} WHERE feature = '{c}'), 6) AS {c}"
        for c in NUM
    )
    return f" SELECT row_key, {columns} FROM test t"


@query(
    "standardise",
    with_flow(TRAIN_LONG + ", sp AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std FROM long GROUP BY 1)" + scaled_sql("sp", "mean", "std")),
)
def standardise(spark, sf_dir):
    base = flow(spark, sf_dir)
    params = encoding.std_params(training(base), NUM)
    return rounded(encoding.standardise(testing(base).select("row_key", *NUM), NUM, params), *NUM)


@query("robust_scale", with_flow(ROBUST_SQL + scaled_sql("robust", "median", "iqr")))
def robust_scale(spark, sf_dir):
    base = flow(spark, sf_dir)
    params = encoding.robust_params(training(base), NUM)
    return rounded(encoding.robust_scale(testing(base).select("row_key", *NUM), NUM, params), *NUM)


@query("category_dict", with_flow(dictionary_sql("flow") + " SELECT feature, category, idx FROM dict"))
def category_dict(spark, sf_dir):
    return encoding.category_dict(flow(spark, sf_dir), CAT)


# fitted on all train rows, inliers and anomalies; categories that only other rows have are unknown
TRAIN_DICT = dictionary_sql("(SELECT * FROM flow WHERE split = 'TRAIN')")


def train_dictionary(spark, sf_dir):
    rows = flow(spark, sf_dir)
    return encoding.category_dict(rows.filter((F.col("part") == "train") & F.col("year").between(PROTOCOL.train_first, PROTOCOL.train_last)), CAT)


@query(
    "onehot_lookup",
    with_flow(TRAIN_DICT + " SELECT row_key, " + ", ".join(f"{c}_d.idx AS {c}_idx" for c in CAT) + " FROM test t "
    + " ".join(f"LEFT JOIN dict {c}_d ON {c}_d.feature = '{c}' AND {c}_d.category = t.{c}" for c in CAT)),
)
def onehot_lookup(spark, sf_dir):
    test = testing(flow(spark, sf_dir)).select("row_key", *CAT)
    return encoding.onehot_lookup(test, CAT, train_dictionary(spark, sf_dir)).drop(*CAT)


TEST_CELLS = ", cells AS (" + " UNION ALL ".join(f"SELECT row_key, '{c}' AS feature, {c} AS category FROM test" for c in CAT) + ")"


@query("one_hot", with_flow(TRAIN_DICT + TEST_CELLS + " SELECT row_key, feature, idx FROM cells JOIN dict USING (feature, category)"))
def one_hot(spark, sf_dir):
    test = testing(flow(spark, sf_dir))
    return encoding.one_hot(test, ["row_key"], CAT, train_dictionary(spark, sf_dir))


_sizes = [f"(SELECT count(*) FROM dict WHERE feature = '{c}')" for c in CAT]
_offsets = {c: " + ".join([str(len(NUM)), *_sizes[:i]]) for i, c in enumerate(CAT)}


@query(
    "hconcat_features",
    with_flow(
        TRAIN_DICT + TEST_CELLS + ", blocks AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_offsets[c]} AS base" for c in CAT) + "), parts AS ("
        + " UNION ALL ".join(f"SELECT row_key, {i} AS pos, {c} AS val FROM test WHERE {c} <> 0" for i, c in enumerate(NUM))
        + " UNION ALL SELECT row_key, base + idx, 1.0 FROM cells JOIN dict USING (feature, category) JOIN blocks USING (feature))"
        + f" SELECT row_key, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions, round(sum(val), 6) AS total, CAST({len(NUM)} + (SELECT count(*) FROM dict) AS INTEGER) AS width"
        + " FROM parts GROUP BY row_key"
    ),
)
def hconcat_features(spark, sf_dir):
    test = testing(flow(spark, sf_dir))
    wide = encoding.hconcat_features(test, NUM, CAT, train_dictionary(spark, sf_dir))
    values = F.transform("features", lambda e: e["val"])
    return wide.select(
        "row_key",
        F.array_join(F.transform("features", lambda e: e["pos"].cast("string")), ",").alias("positions"),
        F.round(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), 6).alias("total"),
        "width",
    )
