"""The flow table: the supplied tables in the shape of a yearly traffic log.

``lineitem`` joined to ``part`` gives one row per flow with categorical and numeric
features, a year and a three-way label. It is prepared once per application as a
table partitioned by (year, part) - the layout every later query prunes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.bins import log_bin
from tidemark.functions.hashing import physical_id
from tidemark.functions.labels import recode_label
from tidemark.operators.ordering import join_same
from tidemark.operators.sampling import HOLDOUT_SEED, mark_holdout
from tidemark.sources.staging import new_path, stage, unstage
from tidemark.spec import FeatureSpec, SplitProtocol

FLOW = FeatureSpec(
    cat=("cat_status", "cat_type", "cat_price", "cat_quantity"),
    num=("num_quantity", "num_price", "num_discount", "num_tax"),
    bonus=("month",),
    label="raw_label",
)
FLOW_SCHEMA = (
    "row_key string, copy_no long, month int, raw_label int, cat_status string, cat_type string, cat_price string, "
    "cat_quantity string, num_quantity double, num_price double, num_discount double, num_tax double, "
    "split string, year int, part string"
)
MANY_PARTS = 1_000_000
TASK_ROWS = 500_000  # rows that one task sorts and writes
PROTOCOL = SplitProtocol(train_first=1995, train_last=1998, near_last=2000)

_prepared: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ITEM = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


def _joined(items: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the type of their part, still in the narrow columns of the tables."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    if parts.count() > MANY_PARTS:  # beyond a broadcast: items pass by the parts of their partition and are not sorted
        parts = parts.hint("shuffle_hash")
    return join_same(items, parts, ["l_partkey"], "left").filter("p_type IS NOT NULL")


def _year():
    return F.year("l_shipdate").alias("year")


def _raw_label():
    flag = F.col("l_returnflag")
    return F.when(flag == "N", 1).when(flag == "A", -1).when(flag == "R", -2).alias("raw_label")


def _row_key():
    return F.concat_ws(
        "|",
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        *[F.floor(F.col(c) * 100 + 0.5) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")],
        "l_returnflag", "l_linestatus", F.unix_date(F.to_date("l_shipdate")),
    ).alias("row_key")


def copy_id():
    return F.md5(F.col("copy_no").cast("string")).alias("copy_id")


def _features() -> list:
    price = F.col("l_extendedprice")
    return [
        F.month("l_shipdate").alias("month"),
        _raw_label(),
        F.col("l_linestatus").alias("cat_status"),
        F.col("p_type").alias("cat_type"),
        log_bin(price, "0").alias("cat_price"),
        log_bin(F.col("l_quantity"), "2").alias("cat_quantity"),
        F.col("l_quantity").alias("num_quantity"),
        price.alias("num_price"),
        F.col("l_discount").alias("num_discount"),
        F.col("l_tax").alias("num_tax"),
    ]


def flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy flow view; ``row_key`` spells out the whole row, ``copy_id`` tells copies apart."""
    items = table(spark, sf_dir, "lineitem").withColumn("copy_id", physical_id())
    return _joined(items, spark, sf_dir).select(_row_key(), "copy_id", _year(), *_features())


def flow_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the prepared flow table, partitioned by (year, part), written on first use.

    The join is written once in its narrow columns; these are counted, marked and dealt out, and the wide columns
    are spelled out by the tasks that write them.
    """
    key = (spark.sparkContext.applicationId, sf_dir, str(spark.conf.get("spark.checkpoint.dir", "")))
    if key not in _prepared:
        path = new_path(spark, "flow")
        items = table(spark, sf_dir, "lineitem").select(*ITEM, F.monotonically_increasing_id().alias("copy_no"))
        narrow = stage(_joined(items, spark, sf_dir), "flow_rows")
        keyed = narrow.select("*", _year(), _raw_label(), _row_key(), copy_id())
        marked = mark_holdout(keyed, 0.1, ["year", "raw_label"], HOLDOUT_SEED).select(*narrow.columns, "year", "part")
        # hot years, orders and copies are split; tasks sort a bounded number of rows, while narrow, so that the writer need not
        tasks = max(spark.sparkContext.defaultParallelism, -(-narrow.count() // TASK_ROWS))
        dealt = marked.repartitionByRange(tasks, "year", "part", "l_orderkey", "copy_no")
        dealt = dealt.sortWithinPartitions("year", "part", "l_orderkey")
        split = PROTOCOL.column(F.col("year"), F.col("part")).alias("split")
        dealt.select(_row_key(), "copy_no", *_features(), split, "year", "part").write.partitionBy("year", "part").parquet(path)
        unstage(narrow)
        _prepared[key] = path
    return _prepared[key]


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow table with ``copy_id``, ``part`` (10 % ``valid`` per year and label) and ``split``.

    ``copy_id`` is computed from the number of the item, stored beside it, and only where it is asked for.
    """
    rows = stored(spark, sf_dir)
    return rows.select("row_key", copy_id(), *rows.columns[2:])


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow table as it is stored: ``copy_no``, a narrow number of the item, in place of ``copy_id``."""
    return spark.read.schema(FLOW_SCHEMA).parquet(flow_path(spark, sf_dir))


def labelled(df: DataFrame) -> DataFrame:
    """Add the binary label (0 inlier, 1 anomaly)."""
    return df.withColumn("label", recode_label(F.col("raw_label")))


def training(df: DataFrame) -> DataFrame:
    """Inlier rows of the training split, chosen by folder (year, part) before any row is read."""
    return labelled(df).filter(PROTOCOL.trained(F.col("year"), F.col("part")) & (F.col("label") == 0))


def testing(df: DataFrame) -> DataFrame:
    """All rows of the IID, NEAR and FAR splits, chosen by folder."""
    known = F.col("year") >= PROTOCOL.train_first
    return labelled(df).filter(known & ~PROTOCOL.trained(F.col("year"), F.col("part")))
