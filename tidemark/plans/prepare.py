"""Queries: scans, sinks, projections, filters, de-duplication, sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.bins import log_bin
from tidemark.functions.hashing import physical_id
from tidemark.functions.labels import anomaly_kind, class_sets, is_outlier, one_vs_rest, recode_label
from tidemark.functions.text import concat_timestamp, split_fields
from tidemark.operators import rows, sampling
from tidemark.operators.ordering import join_same
from tidemark.plans.flow import copy_id, flow, flow_path, flow_rows, labelled, stored, table, testing
from tidemark.plans.registry import EDGES, query, with_flow
from tidemark.sources import sinks, tables
from tidemark.sources.staging import new_path
from tidemark.spec import FeatureSpec, in_distribution_split

NUMBERED = FeatureSpec(cat=("0", "1", "2", "13"), num=("4", "5", "6", "7"), bonus=("14",), label="18")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow table as numbered text columns, the way yearly files are stored."""
    decimal = {"4": "num_quantity", "5": "num_price", "6": "num_discount", "7": "num_tax"}
    return flow(spark, sf_dir).select(
        F.col("cat_price").alias("0"),
        F.col("cat_type").alias("1"),
        F.col("cat_quantity").alias("2"),
        *[F.col(c).cast("decimal(18,2)").cast("string").alias(n) for n, c in decimal.items()],
        F.col("cat_status").alias("13"),
        F.col("month").cast("string").alias("14"),
        F.col("raw_label").cast("string").alias("18"),
        "row_key",
        "year",
        "part",
    )


# --- scans and sinks -------------------------------------------------------------------


@query("scan_years", with_flow("SELECT row_key, year, part, num_price FROM flow WHERE part = 'train' AND year IN (1996, 1997, 2000)"))
def scan_years(spark, sf_dir):
    scan = tables.scan_years(spark, flow_path(spark, sf_dir), [1996, 1997, 2000], "train")
    return scan.select("row_key", "year", "part", "num_price")


RAW_SQL = """
WITH raw AS (SELECT l.*, p.p_type, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month
  FROM lineitem l JOIN part p ON l_partkey = p_partkey)"""


def raw_lines(spark, sf_dir) -> DataFrame:
    """Flow rows written out as tab-separated log lines (22 fields), with year and month."""
    items = table(spark, sf_dir, "lineitem").withColumn("copy_id", physical_id())
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    blank = F.lit("0")
    fields = [
        money("l_extendedprice"), F.col("p_type"), money("l_quantity"), money("l_discount"),
        money("l_tax"), *[blank] * 8, F.col("l_linestatus"), F.col("l_returnflag"),
        F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
        F.col("l_linenumber").cast("string"), blank, F.date_format("l_shipdate", "yyyy-MM-dd"),
        F.when(F.col("l_linestatus") == "O", "tcp").otherwise("udp"),
    ]
    return join_same(items, parts, ["l_partkey"], "left").filter("p_type IS NOT NULL").select(
        F.concat_ws("\t", *fields).alias("value"), F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")
    )


@query(
    "scan_raw_log",
    RAW_SQL + """
SELECT CASE WHEN l_extendedprice <= 4009617608.96 THEN 'c0' || (len(list_filter(e, lambda b: b < l_extendedprice)) - 1) ELSE 'nan' END AS f0,
  p_type AS f1, 'c2' || (len(list_filter(e, lambda b: b < l_quantity)) - 1) AS f2,
  'c3' || (len(list_filter(e, lambda b: b < l_discount)) - 1) AS f3,
  CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) AS f4, l_linestatus AS f13, l_returnflag AS f14,
  CAST(l_orderkey AS VARCHAR) AS f15, CAST(l_partkey AS VARCHAR) AS f16, CAST(l_suppkey AS VARCHAR) AS f17,
  concat_ws('_', year, month, strftime(l_shipdate, '%Y-%m-%d')) AS f18,
  CASE l_linestatus WHEN 'O' THEN 'tcp' ELSE 'udp' END AS f19, year, month
FROM raw CROSS JOIN (SELECT EDGES AS e)""".replace("EDGES", EDGES),
)
def scan_raw_log(spark, sf_dir):
    path = new_path(spark, "raw_log")
    raw_lines(spark, sf_dir).hint("rebalance", "y", "m").write.partitionBy("y", "m").text(path)
    parsed = tables.bin_raw_columns(tables.scan_raw_log(spark, path))
    kept = ["0", "1", "2", "3", "4", "13", "14", "15", "16", "17", "18", "19"]
    return parsed.select(*[F.col(f"`{c}`").alias(f"f{c}") for c in kept], "year", "month")


@query("scan_delimited", "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def scan_delimited(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    path = new_path(spark, "csv")
    part.write.option("header", "false").csv(path)
    return tables.scan_delimited(spark, path, part.schema)


@query("scan_delimited_blanks", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def scan_delimited_blanks(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    path = new_path(spark, "blanks")
    supplier.select(F.concat_ws("   ", *supplier.columns).alias("value")).write.text(path)
    return tables.scan_delimited(spark, path, supplier.schema, whitespace=True)


@query(
    "sink_halfyear",
    with_flow("""SELECT year, CAST(CASE WHEN year = 1995 THEN 0 WHEN month <= 6 THEN 1 ELSE 2 END AS INTEGER) AS half,
  count(*) AS n, round(sum(num_price), 2) AS price FROM flow0 GROUP BY 1, 2"""),
)
def sink_halfyear(spark, sf_dir):
    path = new_path(spark, "halfyear")
    sinks.sink_halfyear(flow_rows(spark, sf_dir).drop("copy_id"), path, single_years=(1995,))
    back = spark.read.parquet(path)
    return back.groupBy("year", "half").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("num_price").cast("double")), 2).alias("price")
    )


@query(
    "sink_train_test",
    with_flow("SELECT year, part, raw_label, count(*) AS n, min(row_key) AS first_key FROM flow GROUP BY ALL"),
)
def sink_train_test(spark, sf_dir):
    path = new_path(spark, "train_test")
    sinks.sink_train_test(flow_rows(spark, sf_dir), path, 0.1, ("year", "raw_label"))
    back = spark.read.parquet(path)
    return back.groupBy("year", "part", "raw_label").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_key").alias("first_key")
    )


# --- columns ---------------------------------------------------------------------------


@query("project_keep", with_flow("SELECT cat_status, cat_type, num_quantity, raw_label, year FROM flow"))
def project_keep(spark, sf_dir):
    return rows.project_keep(flow(spark, sf_dir), ["cat_status", "cat_type", "num_quantity", "raw_label", "year", "absent"])


@query(
    "rename_roles",
    with_flow("""SELECT cat_price AS cat_0, cat_type AS cat_1, cat_quantity AS cat_2, cat_status AS cat_13,
  num_quantity AS num_4, num_price AS num_5, num_discount AS num_6, num_tax AS num_7,
  CAST(month AS VARCHAR) AS bonus_14, raw_label AS label, row_key FROM flow"""),
)
def rename_roles(spark, sf_dir):
    return rows.rename_roles(numbered(spark, sf_dir), NUMBERED, extra=["row_key"])


@query(
    "cast_numeric",
    with_flow("""SELECT row_key, num_quantity AS n4, num_price AS n5, num_discount AS n6, num_tax AS n7,
  CAST(NULL AS DOUBLE) AS n1 FROM flow"""),
)
def cast_numeric(spark, sf_dir):
    strict = rows.cast_numeric(numbered(spark, sf_dir), ["4", "5", "6", "7"])
    lenient = rows.cast_numeric(strict, ["1"], strict=False)
    return lenient.select("row_key", *[F.col(f"`{c}`").alias(f"n{c}") for c in ("4", "5", "6", "7", "1")])


@query(
    "cast_all_string",
    """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
  CAST(l_quantity AS VARCHAR) AS l_quantity, CAST(l_extendedprice AS VARCHAR) AS l_extendedprice, l_returnflag FROM lineitem""",
)
def cast_all_string(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return rows.cast_all_string(
        rows.project_keep(items, ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"])
    )


@query("label_recode", with_flow("SELECT row_key, raw_label, label FROM flow"))
def label_recode(spark, sf_dir):
    return flow(spark, sf_dir).select("row_key", "raw_label", recode_label(F.col("raw_label")).alias("label"))


@query("filter_inliers", with_flow("SELECT row_key, year FROM flow WHERE raw_label = 1"))
def filter_inliers(spark, sf_dir):
    return rows.split_inliers_outliers(numbered(spark, sf_dir), "18", "1")[0].select("row_key", "year")


@query("filter_outliers", with_flow("SELECT row_key, year FROM flow WHERE raw_label IS DISTINCT FROM 1"))
def filter_outliers(spark, sf_dir):
    return rows.split_inliers_outliers(numbered(spark, sf_dir), "18", "1")[1].select("row_key", "year")


@query(
    "filter_anomaly_kind",
    with_flow("""SELECT year, CASE raw_label WHEN 1 THEN 'inlier' WHEN -1 THEN 'known' ELSE 'unknown' END AS kind,
  count(*) AS n, round(avg(num_price), 4) AS price FROM flow GROUP BY 1, 2"""),
)
def filter_anomaly_kind(spark, sf_dir):
    kinds = flow(spark, sf_dir).withColumn("kind", anomaly_kind(F.col("raw_label")))
    return kinds.groupBy("year", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("num_price"), 4).alias("price"))


@query(
    "filter_class_sets",
    "SELECT vec_id, label, CAST(CASE WHEN label <= 6 THEN 0 ELSE 1 END AS INTEGER) AS cls FROM embeddings WHERE label <> 7",
)
def filter_class_sets(spark, sf_dir):
    classed = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", class_sets(F.col("label"), range(7), (8, 9)).alias("cls")
    )
    return classed.filter("cls IS NOT NULL")


@query("one_vs_rest_label", "SELECT vec_id, label, CAST(label <> 0 AS INTEGER) AS anomaly FROM embeddings")
def one_vs_rest_label(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", one_vs_rest(F.col("label"), 0).alias("anomaly"))


@query("drop_null_rows", with_flow("SELECT row_key, num_tax, num_discount FROM flow WHERE num_tax <> 0 AND num_discount <> 0"))
def drop_null_rows(spark, sf_dir):
    gaps = flow(spark, sf_dir).select(
        "row_key", F.nullif("num_tax", F.lit(0.0)).alias("num_tax"), F.nullif("num_discount", F.lit(0.0)).alias("num_discount")
    )
    return rows.drop_null_rows(gaps)


@query(
    "nan_to_num",
    with_flow("""SELECT row_key, CASE WHEN num_tax = 0 THEN 0.0 WHEN num_discount = 0 THEN 1.7976931348623157e308
  WHEN num_discount = 0.01 THEN -1.7976931348623157e308 ELSE num_price END AS value FROM flow"""),
)
def nan_to_num(spark, sf_dir):
    dirty = (
        F.when(F.col("num_tax") == 0, F.lit(float("nan")))
        .when(F.col("num_discount") == 0, F.lit(float("inf")))
        .when(F.col("num_discount") == 0.01, F.lit(float("-inf")))
        .otherwise(F.col("num_price"))
    )
    return flow(spark, sf_dir).select("row_key", rows.nan_to_num(dirty).alias("value"))


@query("drop_label", with_flow("SELECT row_key, cat_status, cat_type, num_quantity FROM flow"))
def drop_label(spark, sf_dir):
    kept = flow(spark, sf_dir).select("row_key", "cat_status", "cat_type", "num_quantity", "raw_label")
    return rows.drop_label(kept, "raw_label")


@query(
    "replace_values",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '0' WHEN '2-HIGH' THEN '1' WHEN '5-LOW' THEN '2'
  ELSE o_orderpriority END AS priority FROM orders""",
)
def replace_values(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    return rows.replace_values(orders, "priority", {"1-URGENT": "0", "2-HIGH": "1", "5-LOW": "2"})


@query(
    "reindex_columns",
    """SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST(NULL AS VARCHAR) AS s_phone, CAST(s_nationkey AS BIGINT) AS s_nationkey,
  CAST(NULL AS DOUBLE) AS s_rating FROM supplier""",
)
def reindex_columns(spark, sf_dir):
    wanted = T.StructType(
        [
            T.StructField("s_suppkey", T.LongType()),
            T.StructField("s_phone", T.StringType()),
            T.StructField("s_nationkey", T.LongType()),
            T.StructField("s_rating", T.DoubleType()),
        ]
    )
    return rows.reindex_columns(table(spark, sf_dir, "supplier"), wanted)


@query(
    "split_assign",
    with_flow("""SELECT year, part, split,
  CASE WHEN year <= 1999 THEN CASE part WHEN 'valid' THEN 'ID' ELSE 'TRAIN' END END AS id_split, count(*) AS n
FROM flow GROUP BY ALL"""),
)
def split_assign(spark, sf_dir):
    years = tuple(range(1995, 2002))
    ids = in_distribution_split(F.col("year"), F.col("part"), years, first_five=True)
    return (
        flow(spark, sf_dir)
        .withColumn("id_split", ids)
        .groupBy("year", "part", "split", "id_split")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "log_bin",
    "SELECT l_orderkey, l_linenumber, b0, b2, b3, bx FROM (SELECT *, "
    + ", ".join(
        f"CASE WHEN {x} > e[1] AND {x} <= e[233] THEN '{p}' || (len(list_filter(e, lambda b: b < {x})) - 1) ELSE 'nan' END AS {n}"
        for n, p, x in (
            ("b0", "c0", "l_extendedprice"),
            ("b2", "c2", "(l_quantity - 1)"),
            ("b3", "c3", "(l_discount - 0.05::DOUBLE)"),
            ("bx", "c0", "(l_extendedprice * 100000)"),
        )
    )
    + f" FROM lineitem CROSS JOIN (SELECT {EDGES} AS e))",
)
def log_bins(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        log_bin(F.col("l_extendedprice"), "0").alias("b0"),
        log_bin(F.col("l_quantity") - 1, "2").alias("b2"),
        log_bin(F.col("l_discount") - 0.05, "3").alias("b3"),
        log_bin(F.col("l_extendedprice") * 100000, "0").alias("bx"),
    )


@query(
    "split_fields",
    RAW_SQL + """
SELECT 18 AS n_fields, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS f0, CAST(l_suppkey AS VARCHAR) AS f17,
  CASE l_linestatus WHEN 'O' THEN 'tcp' ELSE 'udp' END AS proto FROM raw""",
)
def split_raw_fields(spark, sf_dir):
    fields = split_fields(F.col("value"))
    return raw_lines(spark, sf_dir).select(
        F.size(fields).alias("n_fields"),
        F.get(fields, F.lit(0)).alias("f0"),
        F.get(fields, F.lit(17)).alias("f17"),
        F.element_at(F.split("value", "\t"), -1).alias("proto"),
    )


@query(
    "concat_timestamp",
    RAW_SQL + "\nSELECT concat_ws('_', year, month, strftime(l_shipdate, '%Y-%m-%d')) AS stamp, count(*) AS n FROM raw GROUP BY 1",
)
def concat_timestamps(spark, sf_dir):
    clock = F.element_at(F.split("value", "\t"), -2)
    stamped = raw_lines(spark, sf_dir).select(
        concat_timestamp(F.col("y").cast("string"), F.col("m").cast("string"), clock).alias("stamp")
    )
    return stamped.groupBy("stamp").agg(F.count(F.lit(1)).alias("n"))


# --- set operations --------------------------------------------------------------------


@query("union_years", with_flow("SELECT row_key, year, split FROM flow WHERE year IN (1995, 1999, 2001)"))
def union_years(spark, sf_dir):
    path = flow_path(spark, sf_dir)
    frames = [tables.scan_years(spark, path, [y]).select("row_key", "year", "split") for y in (1995, 1999, 2001)]
    return rows.union_years(frames)


@query("distinct_first", "SELECT lang, md5(text) AS text_md5 FROM (SELECT DISTINCT lang, text FROM documents)")
def distinct_first(spark, sf_dir):
    texts = rows.distinct_first(table(spark, sf_dir, "documents"), ["lang", "text"])
    return texts.select("lang", F.md5("text").alias("text_md5"))


FEATURES = ["cat_status", "cat_type", "cat_price", "num_quantity", "num_discount"]


@query(
    "distinct_first_per_class",
    with_flow(f"SELECT DISTINCT year, raw_label IS DISTINCT FROM 1 AS is_outlier, {', '.join(FEATURES)} FROM flow"),
)
def distinct_first_per_class(spark, sf_dir):
    classed = flow(spark, sf_dir).withColumn("is_outlier", is_outlier(F.col("raw_label")))
    return rows.distinct_first(classed, ["year", "is_outlier", *FEATURES])


@query(
    "distinct_none",
    with_flow(f"""SELECT year, half, {', '.join(FEATURES)} FROM (
  SELECT *, CAST(CASE WHEN month <= 6 THEN 1 ELSE 2 END AS INTEGER) AS half FROM flow0) GROUP BY ALL HAVING count(*) = 1"""),
)
def distinct_none(spark, sf_dir):
    halves = flow(spark, sf_dir).withColumn("half", F.when(F.col("month") <= 6, 1).otherwise(2))
    return rows.distinct_none(halves, ["year", "half", *FEATURES])


@query(
    "distinct_none_monthly",
    with_flow(f"""SELECT year, half, {', '.join(FEATURES)}, CAST(max(month) FILTER (WHERE n = 1) AS INTEGER) AS month FROM (
  SELECT year, CAST(CASE WHEN month <= 6 THEN 1 ELSE 2 END AS INTEGER) AS half, {', '.join(FEATURES)}, month, count(*) AS n FROM flow0 GROUP BY ALL)
GROUP BY year, half, {', '.join(FEATURES)}
HAVING list_reduce(list_prepend(0::BIGINT, list(n ORDER BY month)), lambda s, c: CASE WHEN s + c = 1 THEN 1::BIGINT ELSE 0::BIGINT END) = 1"""),
)
def distinct_none_monthly(spark, sf_dir):
    halves = flow(spark, sf_dir).withColumn("half", F.when(F.col("month") <= 6, 1).otherwise(2))
    return rows.distinct_none_in_steps(halves, "month", ["year", "half", *FEATURES])


@query(
    "held_out_antijoin",
    with_flow(f"""SELECT year, raw_label, {', '.join(FEATURES)} FROM (
  SELECT year, raw_label, {', '.join(FEATURES)} FROM flow
  UNION ALL SELECT year, raw_label, {', '.join(FEATURES)} FROM flow WHERE part = 'valid') GROUP BY ALL HAVING count(*) = 1"""),
)
def held_out_antijoin(spark, sf_dir):
    everything = flow(spark, sf_dir)
    held_out = everything.filter(F.col("part") == "valid")
    return rows.held_out_rows(everything, held_out, ["year", "raw_label", *FEATURES])


@query("held_out_by_id", with_flow("SELECT row_key, year FROM flow WHERE part = 'train'"))
def held_out_by_id(spark, sf_dir):
    everything = flow(spark, sf_dir).select("row_key", "copy_id", "year", "part")
    held_out = everything.filter(F.col("part") == "valid")
    return rows.held_out_antijoin(everything, held_out, ["row_key", "copy_id"]).select("row_key", "year")


@query(
    "score_label_align",
    """SELECT d.doc_id, d.n_chars AS score, l.toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def score_label_align(spark, sf_dir):
    scores = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"))
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return join_same(scores, truth, ["doc_id"])


@query(
    "shape_counts",
    with_flow(f"""SELECT year, 'all' AS stage, count(*) AS n FROM flow GROUP BY 1
UNION ALL SELECT year, 'inliers', count(*) FROM flow WHERE raw_label = 1 GROUP BY 1
UNION ALL SELECT year, 'distinct', count(*) FROM (SELECT DISTINCT year, {', '.join(FEATURES)} FROM flow) GROUP BY 1
UNION ALL SELECT year, part, count(*) FROM flow GROUP BY 1, 2"""),
)
def shape_counts(spark, sf_dir):
    base = flow(spark, sf_dir)
    stages = {
        "all": base.select("year"),
        "inliers": base.filter(F.col("raw_label") == 1).select("year"),
        "distinct": rows.distinct_first(base, ["year", *FEATURES]).select("year"),
        "train": base.filter(F.col("part") == "train").select("year"),
        "valid": base.filter(F.col("part") == "valid").select("year"),
    }
    tagged = [frame.withColumn("stage", F.lit(name)) for name, frame in stages.items()]
    return rows.union_years(tagged).groupBy("year", "stage").agg(F.count(F.lit(1)).alias("n"))


# --- sampling and splitting ------------------------------------------------------------


@query(
    "sample_frac",
    with_flow("""SELECT row_key, year FROM flow
QUALIFY row_number() OVER (ORDER BY md5('42|' || row_key)) <= round_even(CAST(0.05 AS DOUBLE) * count(*) OVER (), 0)"""),
)
def sample_frac(spark, sf_dir):
    return sampling.sample_fraction(flow(spark, sf_dir), 0.05, 42).select("row_key", "year")


@query(
    "sample_n",
    with_flow("SELECT row_key, year FROM flow QUALIFY row_number() OVER (PARTITION BY year ORDER BY md5('46|' || row_key)) <= 300"),
)
def sample_n(spark, sf_dir):
    return sampling.sample_rows(flow(spark, sf_dir), 300, 46, ["year"]).select("row_key", "year")


SHARE = 0.25  # anomalies in the contaminated train rows


@query(
    "contaminate_train",
    with_flow(f""",
seen AS (SELECT *, raw_label <> 1 AS bad, count(*) OVER (PARTITION BY year, raw_label <> 1) AS n, count(*) OVER (PARTITION BY year) AS n_all
  FROM flow WHERE part = 'train' AND year <= 1998),
sub AS (SELECT * EXCLUDE (n, n_all), count(*) OVER (PARTITION BY year) AS n_all FROM (SELECT * FROM seen
  QUALIFY row_number() OVER (PARTITION BY year, bad ORDER BY md5('5|' || row_key))
    <= CASE WHEN bad THEN ceil((n_all - n) * {SHARE / (1 - SHARE)!r}::DOUBLE) ELSE floor((n_all - n) / {SHARE / (1 - SHARE)!r}::DOUBLE) END)),
mixed AS (SELECT * FROM sub QUALIFY row_number() OVER (PARTITION BY year, bad ORDER BY md5('102|' || row_key))
    <= floor(n_all * CASE WHEN bad THEN {SHARE!r}::DOUBLE ELSE {1 - SHARE!r}::DOUBLE END))
SELECT DISTINCT raw_label, cat_status, cat_type, cat_price, num_quantity, num_discount FROM mixed"""),
)
def contaminate_train(spark, sf_dir):
    """A quarter of anomalies in each whole year, thinned only as far as the quotas of both classes can be met."""
    train = flow(spark, sf_dir).filter((F.col("part") == "train") & (F.col("year") <= 1998))
    train = train.withColumn("is_outlier", is_outlier(F.col("raw_label")))
    mixed = sampling.contaminate(sampling.with_share(train, SHARE, 5), SHARE, 102)
    return rows.drop_null_rows(rows.distinct_first(mixed, ["raw_label", *FEATURES]))


@query("stratified_holdout", with_flow("SELECT row_key, year, raw_label, part FROM flow"))
def stratified_holdout(spark, sf_dir):
    marked = sampling.mark_holdout(flow_rows(spark, sf_dir), 0.1, ["year", "raw_label"])
    return marked.select("row_key", "year", "raw_label", "part")


@query(
    "train_val_split",
    with_flow("""SELECT row_key, CASE WHEN row_number() OVER (ORDER BY md5('0|' || row_key)) <= ceil(CAST(0.001 AS DOUBLE) * count(*) OVER ())
  THEN 'val' ELSE 'train' END AS part FROM flow"""),
)
def train_val_split(spark, sf_dir):
    return sampling.train_val_split(flow(spark, sf_dir).drop("part"), 0.001, 0).select("row_key", "part")


@query(
    "half_inlier_split",
    """SELECT vec_id, label, CASE WHEN label = 0 AND row_number() OVER (PARTITION BY label ORDER BY md5('5|' || vec_id))
  <= count(*) OVER (PARTITION BY label) // 2 + 1 THEN 'train' ELSE 'test' END AS part
FROM (SELECT vec_id, CAST(label = 9 AS INTEGER) AS label FROM embeddings)""",
)
def half_inlier_split(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") == 9).cast("int").alias("label"))
    return sampling.half_inlier_split(vectors, 5, key="vec_id", copy=None)


@query(
    "ratio_downsample",
    with_flow("""SELECT row_key, label FROM flow WHERE label = 0
UNION ALL (SELECT row_key, label FROM flow WHERE label = 1
  QUALIFY row_number() OVER (ORDER BY md5('6|' || row_key)) <= (SELECT count(*) FROM flow WHERE label = 0) // 4)"""),
)
def ratio_downsample(spark, sf_dir):
    return sampling.ratio_downsample(labelled(flow(spark, sf_dir)), 6).select("row_key", "label")


@query(
    "label_swap_minority",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS minority_is_normal,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS INTEGER) AS normal_is_normal FROM orders""",
)
def label_swap_minority(spark, sf_dir):
    named = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(named == "F", 1).otherwise(0).alias("minority_is_normal"),
        one_vs_rest(named, "F").alias("normal_is_normal"),
    )


@query(
    "shuffle_rows",
    with_flow("SELECT row_key, row_number() OVER (ORDER BY md5('102|' || row_key)) AS position FROM flow"),
)
def shuffle_rows(spark, sf_dir):
    rows = stored(spark, sf_dir).select("row_key", "copy_no")  # copy ids are computed where they are compared
    return sampling.shuffle_rows(rows, 102, copy=copy_id()).select("row_key", "position")


@query(
    "batch_number",
    with_flow("""SELECT row_key, label, batch FROM (SELECT row_key, label,
  (row_number() OVER (PARTITION BY label ORDER BY md5('102|' || row_key)) - 1) // 512 AS batch,
  greatest(count(*) OVER (PARTITION BY label) // 512 - 1, 1) AS steps FROM test) WHERE batch < steps"""),
)
def batch_number(spark, sf_dir):
    test = testing(flow(spark, sf_dir)).select("row_key", "copy_id", "label")
    return sampling.batch_numbers(test, 512, 102, ["label"], skip_tail=True).select("row_key", "label", "batch")
