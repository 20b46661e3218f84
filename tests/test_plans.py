"""Physical plans: pruned scans and early limits."""

import re

import pytest

import __spark_entry__ as contract
from tidemark.operators import metrics
from tidemark.plans import flow as flows
from tidemark.plans.prepare import numbered
from tidemark.sources.tables import scan_years

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")  # filters in full
    return df._jdf.queryExecution().executedPlan().toString()


def test_years_and_part_are_pruned_by_folder(spark):
    scan = scan_years(spark, flows.flow_path(spark, SF_DIR), [1996], "train").select("num_price")
    text = plan(scan)
    assert re.search(r"PartitionFilters: \[.*year.*1996.*part.*train", text) or re.search(r"PartitionFilters: \[.*train.*1996", text)
    assert "ReadSchema: struct<num_price:double>" in text


def test_only_needed_columns_are_read(spark):
    text = plan(contract.queries()["class_counts"](spark, SF_DIR))
    assert "ReadSchema: struct<raw_label:int>" in text


def test_filters_reach_the_scan(spark):
    text = plan(contract.queries()["filter_anomaly_kind"](spark, SF_DIR).filter("year = 1999"))
    assert "PartitionFilters: [isnotnull(year" in text
    inliers = flows.flow(spark, SF_DIR).filter("raw_label = 1").select("num_tax")
    assert "EqualTo(raw_label,1)" in plan(inliers)


@pytest.mark.parametrize("name", ["tokenize_ws", "vocab_lookup", "tokenize_sentences", "mask_positions", "mlm_corrupt"])
def test_vocabulary_lookups_move_no_rows(spark, name):
    text = plan(contract.queries()[name](spark, SF_DIR))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "hashpartitioning(coalesce" not in text  # how a shuffled lookup would deal out its rows


def test_numbered_columns_keep_pruning(spark):
    text = plan(numbered(spark, SF_DIR).select("18"))
    assert "ReadSchema: struct<raw_label:int>" in text


def test_metrics_read_only_label_and_score(spark):
    rows = flows.testing(flows.flow(spark, SF_DIR)).selectExpr("year", "label", "num_price AS score", "row_key")
    text = plan(metrics.class_counts(rows))
    assert "row_key" not in text.split("ReadSchema")[1]


def test_splits_are_chosen_by_folder(spark):
    base = flows.flow(spark, SF_DIR)
    for rows, years in ((flows.training(base), range(1995, 1999)), (flows.testing(base), range(1995, 2002))):
        scan = plan(rows.select("num_tax"))
        assert re.search(r"PartitionFilters: \[[^\]]*part", scan) and "split" not in scan
        assert {r["year"] for r in rows.select("year").distinct().collect()} == set(years)
    assert flows.training(base).filter("split <> 'TRAIN'").isEmpty()
    assert flows.testing(base).count() == base.filter("split <> 'TRAIN'").count()
