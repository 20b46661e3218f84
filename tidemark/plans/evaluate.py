"""Queries: detection metrics, curves, ranks and drift reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import drift, metrics
from tidemark.operators.encoding import max_abs_z, std_params
from tidemark.operators.ordering import join_same
from tidemark.operators.sampling import batch_numbers
from tidemark.plans.flow import FLOW, flow, table, testing, training
from tidemark.plans.registry import Z_SQL, long_metrics, metrics_sql, query, with_flow

NUM = list(FLOW.num)


def toxicity(spark, sf_dir) -> DataFrame:
    """Real 0/1 labels with a heavily tied score, grouped by language."""
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    scores = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return join_same(scores, truth, ["doc_id"])


TOXIC_SQL = """WITH scored AS (SELECT lang, toxic AS label, CAST(n_chars AS DOUBLE) AS score
  FROM documents JOIN labels USING (doc_id))"""


def z_scored(spark, sf_dir) -> DataFrame:
    """Test rows scored by the largest absolute z-score against the training inliers."""
    base = flow(spark, sf_dir)
    params = std_params(training(base), NUM)
    return max_abs_z(testing(base), NUM, params)


def two_methods(spark, sf_dir) -> DataFrame:
    """(method, year, split, label, score) for two simple scores of every test row."""
    scored = z_scored(spark, sf_dir)
    both = F.array(
        F.struct(F.lit("max_abs_z").alias("method"), F.col("score").alias("s")),
        F.struct(F.lit("negative_price").alias("method"), (-F.col("num_price")).alias("s")),
    )
    return scored.select("year", "split", "label", F.inline(both)).withColumnRenamed("s", "score")


TWO_SQL = (
    Z_SQL
    + """,
scored AS (SELECT 'max_abs_z' AS method, year, split, label, score FROM z
  UNION ALL SELECT 'negative_price', year, split, label, -num_price FROM z)"""
    + metrics_sql("method, year, split")
    + long_metrics("method, year, split")
)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def metric_query(name: str):
    @query(name, TOXIC_SQL + metrics_sql("lang") + f" SELECT lang, round({name.replace('max_f1', 'max_f1_outlier')}, 6) AS value FROM wide")
    def one(spark, sf_dir):
        column = "max_f1_outlier" if name == "max_f1" else name
        wide = metrics.curve_metrics(metrics.cum_confusion(toxicity(spark, sf_dir), ["lang"]), ["lang"])
        return wide.select("lang", F.round(column, 6).alias("value"))

    return one


for _name in ("roc_auc", "pr_auc_outlier", "pr_auc_inlier", "max_f1"):
    metric_query(_name)


@query(
    "cum_confusion",
    TOXIC_SQL + metrics_sql("lang") + """
SELECT lang, score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(n_pos AS BIGINT) AS n_pos,
  CAST(n_neg AS BIGINT) AS n_neg FROM cum""",
)
def cum_confusion(spark, sf_dir):
    curve = metrics.cum_confusion(toxicity(spark, sf_dir), ["lang"])
    return curve.select("lang", "score", "tp", "fp", "n_pos", "n_neg")


@query(
    "pr_curve",
    TOXIC_SQL + metrics_sql("lang") + """
SELECT lang, score, round(p_out, 6) AS precision, round(r_out, 6) AS recall FROM pr
UNION ALL SELECT DISTINCT lang, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM pr""",
)
def pr_curve(spark, sf_dir):
    curve = metrics.cum_confusion(toxicity(spark, sf_dir), ["lang"])
    return rounded(metrics.pr_points(curve, ["lang"]), "precision", "recall")


@query(
    "tie_rank",
    """WITH r AS (SELECT lang, CAST(n_chars AS DOUBLE) AS score, rank() OVER (PARTITION BY lang ORDER BY n_chars) AS low
  FROM documents JOIN labels USING (doc_id))
SELECT lang, score, count(*) AS n, max(low) + (count(*) - 1) / 2.0::DOUBLE AS avg_rank FROM r GROUP BY 1, 2""",
)
def tie_rank(spark, sf_dir):
    return metrics.tie_rank(toxicity(spark, sf_dir), ["lang"])


@query("class_counts", with_flow("SELECT year, count(*) FILTER (label = 0) AS n_normal, count(*) FILTER (label = 1) AS n_anomaly FROM flow GROUP BY 1"))
def class_counts(spark, sf_dir):
    base = flow(spark, sf_dir)
    return metrics.class_counts(base.select("year", (F.col("raw_label") != 1).cast("int").alias("label")))


@query("negate_score", with_flow("SELECT row_key, -num_price AS score FROM test"))
def negate_score(spark, sf_dir):
    return testing(flow(spark, sf_dir)).select("row_key", (-F.col("num_price")).alias("score"))


@query("eval_grid", with_flow(TWO_SQL + " SELECT method, year, split, metric, round(value, 6) AS value FROM metrics"))
def eval_grid(spark, sf_dir):
    return rounded(metrics.eval_grid(two_methods(spark, sf_dir), ["method", "year", "split"]), "value")


@query(
    "split_macro_avg",
    with_flow(TWO_SQL + " SELECT method, split, metric, round(avg(value), 6) AS value, count(value) AS n_years FROM metrics GROUP BY 1, 2, 3"),
)
def split_macro_avg(spark, sf_dir):
    grid = metrics.eval_grid(two_methods(spark, sf_dir), ["method", "year", "split"])
    return rounded(metrics.split_macro_avg(grid), "value")


@query(
    "drift_lag",
    with_flow(TWO_SQL + """ SELECT method, metric, year, round(value, 6) AS value,
  round(value - lag(value) OVER (PARTITION BY method, metric ORDER BY year), 6) AS change FROM metrics"""),
)
def drift_lag(spark, sf_dir):
    grid = metrics.eval_grid(two_methods(spark, sf_dir), ["method", "year", "split"]).drop("split")
    return rounded(drift.drift_lag(grid, ["method", "metric"]), "value", "change")


@query(
    "best_so_far",
    with_flow(TWO_SQL + """ SELECT method, metric, year, round(value, 6) AS value,
  round(max(value) OVER (PARTITION BY method, metric ORDER BY year), 6) AS best FROM metrics"""),
)
def best_so_far(spark, sf_dir):
    grid = metrics.eval_grid(two_methods(spark, sf_dir), ["method", "year", "split"]).drop("split")
    return rounded(drift.best_so_far(grid, ["method", "metric"], "year", lowest=False), "value", "best")


@query(
    "sink_metrics",
    TOXIC_SQL + metrics_sql("lang") + long_metrics("lang") + """
SELECT run, lang, metric, round(value, 6) AS value FROM metrics CROSS JOIN (VALUES (1), (2)) r(run)""",
)
def sink_metrics(spark, sf_dir):
    from tidemark.sources.sinks import sink_metrics as write
    from tidemark.sources.staging import new_path

    path = new_path(spark, "metrics")
    grid = metrics.eval_grid(toxicity(spark, sf_dir), ["lang"])
    for run in ("1", "2", "1"):  # a second run adds to the first, a repeated one replaces itself
        write(rounded(grid, "value"), path, run)
    return spark.read.schema("run int, lang string, metric string, value double").json(path)


@query(
    "run_mean_std",
    """WITH scored AS (SELECT lang, source, toxic AS label, CAST(n_chars AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id))"""
    + metrics_sql("lang, source")
    + """
SELECT lang, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS n_runs
FROM (SELECT lang, coalesce(roc_auc, 0) AS v FROM wide) WHERE v > 0 GROUP BY 1""",
)
def run_mean_std(spark, sf_dir):
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("score"))
    by = ["lang", "source"]  # every source stands for one run
    wide = metrics.curve_metrics(metrics.cum_confusion(join_same(docs, truth, ["doc_id"]), by), by)
    runs = wide.select("lang", F.coalesce("roc_auc", F.lit(0.0)).alias("value"))
    return rounded(metrics.run_mean_std(runs, ["lang"]), "mean", "std")


@query(
    "prf_at_threshold",
    with_flow(Z_SQL + """,
c AS (SELECT year, count(*) FILTER (score >= 1.5 AND label = 1) tp, count(*) FILTER (score >= 1.5 AND label = 0) fp,
  count(*) FILTER (score < 1.5 AND label = 1) fn, count(*) FILTER (score < 1.5 AND label = 0) tn FROM z GROUP BY 1),
k AS (SELECT year, 1 AS class, tp AS h, fp AS f, fn AS m FROM c UNION ALL SELECT year, 0, tn, fn, fp FROM c)
SELECT year, CAST(class AS INTEGER) AS class, round(coalesce(h / nullif(h + f, 0), 0), 6) AS precision,
  round(coalesce(h / nullif(h + m, 0), 0), 6) AS recall, round(coalesce(2 * h / nullif(2 * h + f + m, 0), 0), 6) AS f1,
  h + m AS support FROM k"""),
)
def prf_at_threshold(spark, sf_dir):
    cells = metrics.prf_at_threshold(z_scored(spark, sf_dir), ["year"], 1.5)
    return rounded(cells, "precision", "recall", "f1")


@query(
    "precision_at_n",
    with_flow("""
SELECT year, sum(label)::BIGINT AS tp, max(n)::BIGINT AS n_pos, round(sum(label) / (max(n) + 0.00001), 6) AS precision_at_n
FROM (SELECT year, label, sum(label) OVER (PARTITION BY year) AS n,
    row_number() OVER (PARTITION BY year ORDER BY num_quantity DESC, md5('3|' || row_key)) AS r FROM test)
WHERE r <= n GROUP BY 1"""),
)
def precision_at_n(spark, sf_dir):
    scored = testing(flow(spark, sf_dir)).withColumn("score", F.col("num_quantity"))  # 50 values: large ties
    return rounded(metrics.precision_at_n(scored, ["year"], "row_key", 3, copy="copy_id"), "precision_at_n")


@query(
    "class_mean_score",
    with_flow(Z_SQL + """
SELECT year, label, round(avg(m), 6) AS mean_score, count(*) AS n_batches FROM (
  SELECT year, label, batch, avg(score) AS m FROM (
    SELECT year, label, score, (row_number() OVER (PARTITION BY year, label ORDER BY md5('102|' || row_key)) - 1) // 512 AS batch FROM z)
  GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
)
def class_mean_score(spark, sf_dir):
    scored = z_scored(spark, sf_dir).select("row_key", "copy_id", "year", "label", "score")
    batches = batch_numbers(scored, 512, 102, ["year", "label"])
    return rounded(metrics.class_mean_score(batches, ["year", "label"]), "mean_score")


@query(
    "weighted_occurrence",
    with_flow("""
SELECT year, label, round(avg(num_quantity), 6) AS mean_score, round(avg(m), 6) AS unweighted FROM (
  SELECT year, label, num_quantity, avg(q) OVER (PARTITION BY year, label) AS m FROM (
    SELECT year, label, num_quantity, CASE WHEN row_number() OVER (PARTITION BY year, label, cat_type, num_quantity) = 1
      THEN num_quantity END AS q FROM test)) GROUP BY 1, 2"""),
)
def weighted_occurrence(spark, sf_dir):
    test = testing(flow(spark, sf_dir))
    merged = test.groupBy("year", "label", "cat_type", "num_quantity").agg(F.count(F.lit(1)).alias("n"))
    merged = merged.withColumn("batch", F.lit(0)).withColumn("score", F.col("num_quantity"))
    by = ["year", "label"]
    weighted = metrics.class_mean_score(merged, by, weight="n").drop("n_batches")
    plain = metrics.class_mean_score(merged, by).select(*by, F.col("mean_score").alias("unweighted"))
    return rounded(join_same(weighted, plain, by), "mean_score", "unweighted")


@query("max_normalise", with_flow(Z_SQL + " SELECT row_key, year, round(score / max(score) OVER (PARTITION BY year), 6) AS score FROM z"))
def max_normalise(spark, sf_dir):
    scored = z_scored(spark, sf_dir).select("row_key", "year", "score")
    return rounded(metrics.max_normalise(scored, ["year"]), "score")


@query(
    "top_n_scores",
    with_flow(""" SELECT year, row_key, num_price AS score, CAST(row_number() OVER (PARTITION BY year ORDER BY num_price DESC, row_key) AS INTEGER) AS rank
FROM test QUALIFY rank <= 100"""),
)
def top_n_scores(spark, sf_dir):
    scored = testing(flow(spark, sf_dir)).select("year", "row_key", F.col("num_price").alias("score"))
    return metrics.top_n_scores(scored, ["year"], 100, "row_key")


@query(
    "extreme_examples",
    with_flow(Z_SQL + """
SELECT year, row_key, "end", CAST(rank AS INTEGER) AS rank FROM (
  SELECT year, row_key, 'lowest' AS "end", row_number() OVER (PARTITION BY year ORDER BY round(score, 9), row_key) AS rank FROM z WHERE label = 0
  UNION ALL SELECT year, row_key, 'highest', row_number() OVER (PARTITION BY year ORDER BY round(score, 9) DESC, row_key) FROM z WHERE label = 0)
WHERE rank <= 32"""),
)
def extreme_examples(spark, sf_dir):
    scored = z_scored(spark, sf_dir).withColumn("score", F.round("score", 9))
    ends = metrics.extreme_examples(scored.select("year", "row_key", "label", "score"), ["year"], 32, "row_key")
    return ends.select("year", "row_key", "end", "rank")


JEFFREYS_COLUMNS = ("cat_type", "cat_price", "cat_quantity")


@query(
    "jeffreys_divergence",
    with_flow(
        ", h AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, year, {c} AS category, count(*) AS n FROM flow GROUP BY 1, 2, 3" for c in JEFFREYS_COLUMNS)
        + """),
p AS (SELECT a.feature, a.year, b.year AS previous FROM (SELECT DISTINCT feature, year FROM h) a
  JOIN (SELECT DISTINCT feature, year FROM h) b ON a.feature = b.feature AND b.year = a.year - 1),
j AS (SELECT p.feature, p.year, p.previous, c.category, coalesce(x.n, 0) + 1 AS a, coalesce(y.n, 0) + 1 AS b
  FROM p JOIN (SELECT DISTINCT feature, category FROM h) c ON c.feature = p.feature
  LEFT JOIN h x ON x.feature = p.feature AND x.year = p.year AND x.category = c.category
  LEFT JOIN h y ON y.feature = p.feature AND y.year = p.previous AND y.category = c.category
  WHERE x.n IS NOT NULL OR y.n IS NOT NULL),
q AS (SELECT *, a / sum(a) OVER w AS pa, b / sum(b) OVER w AS pb FROM j WINDOW w AS (PARTITION BY feature, year))
SELECT feature, year, previous, round(sum((pa - pb) * ln(pa / pb)), 6) AS divergence FROM q GROUP BY 1, 2, 3"""
    ),
)
def jeffreys_divergence(spark, sf_dir):
    return rounded(drift.jeffreys_divergence(flow(spark, sf_dir), JEFFREYS_COLUMNS), "divergence")


SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)
SKETCH_SQL = (
    ", s AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, year, CAST(least(len(list_filter(e, lambda b: b < {c} * 1000.0::DOUBLE)) - 1, 232) + 1 AS INTEGER) AS bin,
  count(*) AS n FROM flow CROSS JOIN (SELECT e AS e FROM edges) GROUP BY 1, 2, 3"""
        for c in NUM
    )
    + ")"
)


def yearly_sketch(spark, sf_dir) -> DataFrame:
    """Sketch of the numeric columns, merged from one of the training part and one of the held-out part."""
    rows = flow(spark, sf_dir)
    parts = [drift.numeric_sketch(rows.filter(F.col("part") == part), NUM) for part in ("train", "valid")]
    return drift.merge_sketches(parts)


@query(
    "numeric_drift",
    with_flow(
        SKETCH_SQL
        + """,
p AS (SELECT a.feature, a.year, b.year AS previous FROM (SELECT DISTINCT feature, year FROM s) a
  JOIN (SELECT DISTINCT feature, year FROM s) b ON a.feature = b.feature AND b.year = a.year - 1),
j AS (SELECT p.feature, p.year, p.previous, c.bin, coalesce(x.n, 0) + 1 AS a, coalesce(y.n, 0) + 1 AS b
  FROM p JOIN (SELECT DISTINCT feature, bin FROM s) c ON c.feature = p.feature
  LEFT JOIN s x ON x.feature = p.feature AND x.year = p.year AND x.bin = c.bin
  LEFT JOIN s y ON y.feature = p.feature AND y.year = p.previous AND y.bin = c.bin
  WHERE x.n IS NOT NULL OR y.n IS NOT NULL),
q AS (SELECT *, a / sum(a) OVER w AS pa, b / sum(b) OVER w AS pb FROM j WINDOW w AS (PARTITION BY feature, year))
SELECT feature, year, previous, round(sum((pa - pb) * ln(pa / pb)), 6) AS divergence FROM q GROUP BY 1, 2, 3"""
    ),
)
def numeric_drift(spark, sf_dir):
    return rounded(drift.numeric_divergence(yearly_sketch(spark, sf_dir)), "divergence")


@query(
    "numeric_quantiles",
    with_flow(
        SKETCH_SQL
        + f""",
u AS (SELECT *, sum(n) OVER (PARTITION BY feature, year) AS total, sum(n) OVER (PARTITION BY feature, year ORDER BY bin) AS upto FROM s),
m AS (SELECT feature, year, share, min(bin) AS bin FROM u CROSS JOIN (SELECT unnest({list(SHARES)}::DOUBLE[]) AS share)
  WHERE upto >= share * total GROUP BY 1, 2, 3)
SELECT feature, year, share, round(e[least(bin, 232) + 1] / 1000, 6) AS value FROM m CROSS JOIN (SELECT e AS e FROM edges)"""
    ),
)
def numeric_quantiles(spark, sf_dir):
    return rounded(drift.sketch_quantiles(yearly_sketch(spark, sf_dir), SHARES), "value")
