"""The prepared flow table: narrow rows are moved, tasks sort a bounded number of them, copies stay apart."""

import datetime
import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.functions.hashing import seeded_hash
from tidemark.operators import ordering
from tidemark.plans import flow as flows


def tables(spark, folder, n, parts=40, copies=0):
    """``n`` different items, the first of them ``copies`` more times, and an item whose part is unknown."""
    day = datetime.datetime(1995, 3, 1)
    item = lambda i: (
        i, i % parts, i % 7, i % 3, float(1 + i % 50), 900.0 + i, 0.01 * (i % 10), 0.02, "NAR"[i % 3], "FO"[i % 2], day + datetime.timedelta(days=i % 700),
    )
    rows = [item(i) for i in range(n)] + [item(0)] * copies + [(n, parts + 5, *item(1)[2:])]
    schema = (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    )
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    types = [(i, f"type {i % 9}") for i in range(parts)]
    spark.createDataFrame(types, "p_partkey long, p_type string").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_tasks_sort_and_write_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    """A third of the rows are copies of one: they are dealt over tasks as well, and each has its own copy id."""
    monkeypatch.setattr(flows, "TASK_ROWS", 100, raising=False)
    folder = tables(spark, tmp_path, 1200, copies=600)
    files = glob.glob(f"{flows.flow_path(spark, folder)}/*/*/*.parquet")
    sizes = [pq.read_metadata(f).num_rows for f in files]
    assert sum(sizes) == 1800 and max(sizes) < 400
    assert all("copy_id" not in pq.read_schema(f).names for f in files)
    rows = flows.flow(spark, folder)
    assert rows.select("copy_id").distinct().count() == 1800
    shares = {(r["year"], r["raw_label"]): (r["n"], r["v"]) for r in rows.groupBy("year", "raw_label").agg(F.count("*").alias("n"), F.count_if(F.col("part") == "valid").alias("v")).collect()}
    assert all(v == round(0.1 * n) for n, v in shares.values())


def test_items_meet_many_parts_unsorted(spark, tmp_path, monkeypatch):
    folder = tables(spark, tmp_path, 300)
    few = flows.flow_rows(spark, folder)
    expected = sorted(few.drop("copy_id").collect())
    monkeypatch.setattr(flows, "MANY_PARTS", 10, raising=False)
    many = flows.flow_rows(spark, folder)
    text = many._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text
    assert sorted(many.drop("copy_id").collect()) == expected and len(expected) == 300


def test_counted_are_the_bytes_of_digests_alone(spark, monkeypatch):
    written = {}
    keep = ordering.stage
    monkeypatch.setattr(ordering, "stage", lambda df, name, *a: (written.setdefault(name, df.dtypes), keep(df, name, *a))[1])
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), F.md5(F.col("id").cast("string")).alias("c"))
    kept = ordering.keep_lowest(df, [], F.lit(70), seeded_hash(1, "k"), F.col("c"))
    lowest = df.orderBy(seeded_hash(1, "k")).limit(70)
    assert sorted(kept.collect()) == sorted(lowest.collect())
    assert [t for _, t in written["hashes"] if t != "int"] == ["binary"]
