"""Hand-made tables for the rules that are easy to get wrong."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.bins import log_bin, log_edges
from tidemark.functions.labels import is_inlier, is_outlier, recode_label
from tidemark.functions.text import pad_to_block, row_to_sentence, words
from tidemark.functions.vectors import array_complement, contrastive_loss, feature_windows, window_width
from tidemark.operators import catmodel, encoding, metrics, rows, sampling, tokens
from tidemark.sources import tables


def column(df, name):
    return [r[name] for r in df.collect()]


def test_bins_are_right_closed(spark):
    edges = log_edges()
    cases = [
        (-0.01, "nan"), (-0.009, "c00"), (0.0, "c00"), (0.05, "c00"), (edges[1], "c00"), (math.nextafter(edges[1], 1), "c01"),
        (1.0, "c07"), (86397.394358, "c0119"), (edges[-1], "c0231"), (4294967295.0, "nan"), (None, "nan"),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x double")
    got = column(df.orderBy("i").select(log_bin(F.col("x"), "0").alias("b")), "b")
    assert got == [b for _, b in cases]


def test_every_edge_belongs_to_the_bin_below_it(spark):
    edges = log_edges()
    near = [(i, e, math.nextafter(e, math.inf)) for i, e in enumerate(edges[1:-1])]
    df = spark.createDataFrame(near, "i int, at double, above double")
    out = df.select("i", log_bin(F.col("at"), "2").alias("a"), log_bin(F.col("above"), "2").alias("b")).collect()
    assert all(r["a"] == f"c2{r['i']}" and r["b"] == f"c2{r['i'] + 1}" for r in out)


def test_labels(spark):
    df = spark.createDataFrame([(1,), (-1,), (-2,), (None,)], "y int")
    assert column(df.select(recode_label(F.col("y")).alias("z")), "z") == [0, 1, 1, None]
    assert df.filter(is_inlier(F.col("y"))).count() == 1
    assert df.filter(is_outlier(F.col("y"))).count() == 3  # a missing label is not an inlier


TIES = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.8, 0)]


def scored(spark, pairs, group="g"):
    return spark.createDataFrame([(group, float(s), y) for s, y in pairs], "g string, score double, label int")


def wide(df):
    return metrics.curve_metrics(metrics.cum_confusion(df, ["g"]), ["g"]).first()


def test_curve_metrics_with_ties(spark):
    m = wide(scored(spark, TIES))
    assert m["roc_auc"] == pytest.approx(3.5 / 6)
    assert m["pr_auc_outlier"] == pytest.approx(0.583333, abs=1e-6)
    assert m["max_f1_outlier"] == pytest.approx(2 / 3)


def test_one_class_groups_have_no_auc(spark):
    m = wide(scored(spark, [(0.2, 0), (0.3, 0)]))
    assert m["roc_auc"] is None and m["pr_auc_outlier"] is None and m["max_f1_outlier"] is None


def test_auc_properties(spark):
    flipped = wide(scored(spark, [(-s, y) for s, y in TIES]))
    curved = wide(scored(spark, [(math.exp(3 * s), y) for s, y in TIES]))
    m = wide(scored(spark, TIES))
    assert m["roc_auc"] + flipped["roc_auc"] == pytest.approx(1)
    assert curved["roc_auc"] == pytest.approx(m["roc_auc"])
    assert curved["pr_auc_inlier"] == pytest.approx(m["pr_auc_inlier"])


def test_inlier_area_is_the_outlier_area_of_the_flipped_problem(spark):
    flipped = wide(scored(spark, [(-s, 1 - y) for s, y in TIES]))
    m = wide(scored(spark, TIES))
    assert m["pr_auc_inlier"] == pytest.approx(flipped["pr_auc_outlier"])
    assert m["max_f1_inlier"] == pytest.approx(flipped["max_f1_outlier"])


def test_weights_equal_repeated_rows(spark):
    weighted = spark.createDataFrame([("g", s, y, i + 1) for i, (s, y) in enumerate(TIES)], "g string, score double, label int, w int")
    repeated = scored(spark, [p for i, p in enumerate(TIES) for _ in range(i + 1)])
    a = metrics.curve_metrics(metrics.cum_confusion(weighted, ["g"], weight="w"), ["g"]).first()
    assert a == wide(repeated)


def test_precision_at_n(spark):
    df = spark.createDataFrame(
        [("g", str(i), s, y) for i, (s, y) in enumerate([(9.0, 1), (8.0, 0), (7.0, 1), (1.0, 0)])],
        "g string, k string, score double, label int",
    )
    r = metrics.precision_at_n(df, ["g"], "k").first()
    assert r["tp"] == 1 and r["precision_at_n"] == pytest.approx(1 / 2.00001)


def test_quantiles_and_robust_params(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "x double, flat double")
    q = encoding.exact_quantiles(df, [], "x", [0.25, 0.5, 0.75]).first()
    assert [q["q0"], q["q1"], q["q2"]] == [1.75, 2.5, 4.75]
    fitted = {r["feature"]: (r["median"], r["iqr"]) for r in encoding.robust_params(df, ["x", "flat"]).collect()}
    assert fitted == {"x": (2.5, 3.0), "flat": (5.0, 1.0)}


def test_zero_deviation_becomes_one(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert {r["feature"]: r["std"] for r in encoding.std_params(df, ["a", "b"]).collect()} == {"a": 1.0, "b": 1.0}


def test_copies(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "x string")
    assert sorted(column(rows.distinct_first(df), "x")) == ["a", "b"]
    assert column(rows.distinct_none(df), "x") == ["b"]


def test_held_out_rows_also_lose_copies_inside_the_table(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "x string")
    held = spark.createDataFrame([("a",)], "x string")
    assert column(rows.held_out_rows(df, held), "x") == ["c"]
    assert sorted(column(rows.held_out_antijoin(df, held, ["x"]), "x")) == ["b", "b", "c"]


def keyed(spark, sizes):
    data = [(g, f"{g}-{i}") for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(data, "g string, k string")


def test_holdout_rounds_half_to_even(spark):
    marked = sampling.mark_holdout(keyed(spark, {"a": 5, "b": 15, "c": 25}), 0.1, ["g"], key="k", copy=None)
    held = {r["g"]: r["n"] for r in marked.groupBy("g").agg(F.count_if(F.col("part") == "valid").alias("n")).collect()}
    assert held == {"a": 0, "b": 2, "c": 2}


def test_too_large_a_sample_raises(spark):
    with pytest.raises(ValueError, match="quota larger"):
        sampling.sample_rows(keyed(spark, {"a": 5, "b": 50}), 10, 1, ["g"], key="k", copy=None).count()


def test_contamination_quota(spark):
    data = [(2006, i < 3, f"{i}") for i in range(10)] + [(2007, i < 2, f"{i}") for i in range(10)]
    df = spark.createDataFrame(data, "year int, is_outlier boolean, k string")
    mixed = sampling.contaminate(df.filter("year = 2006"), 0.3, 1, key="k", copy=None)
    assert mixed.count() == 10
    with pytest.raises(ValueError, match="2007"):  # three anomalies asked of two
        sampling.contaminate(df, 0.3, 1, key="k", copy=None).count()
    clean = sampling.contaminate(df, 0.0, 1, key="k", copy=None)
    assert clean.filter("is_outlier").count() == 0 and clean.count() == 15


def test_batches_can_skip_the_tail(spark):
    df = keyed(spark, {"a": 25, "b": 3})
    every = sampling.batch_numbers(df, 10, 1, ["g"], key="k", copy=None)
    assert {(r["g"], r["batch"]): r["count"] for r in every.groupBy("g", "batch").count().collect()} == {
        ("a", 0): 10, ("a", 1): 10, ("a", 2): 5, ("b", 0): 3,
    }
    kept = sampling.batch_numbers(df, 10, 1, ["g"], key="k", copy=None, skip_tail=True)
    assert {(r["g"], r["batch"]) for r in kept.collect()} == {("a", 0), ("b", 0)}


def test_unknown_category_has_no_indicator(spark):
    train = spark.createDataFrame([("x",), ("y",)], "c string")
    test = spark.createDataFrame([(1, "y"), (2, "z"), (3, None)], "id int, c string")
    dictionary = encoding.category_dict(train, ["c"])
    assert [(r["id"], r["idx"]) for r in encoding.one_hot(test, ["id"], ["c"], dictionary).collect()] == [(1, 1)]
    found = {r["id"]: r["c_idx"] for r in encoding.onehot_lookup(test, ["c"], dictionary).collect()}
    assert found == {1: 1, 2: None, 3: None}


def test_vocabulary(spark):
    vocab = {r["token"]: r["id"] for r in tokens.vocab_generate(spark).collect()}
    assert len(vocab) == 951 and sorted(vocab.values()) == list(range(951))
    assert vocab["[UNK]"] == 0 and vocab["[PAD]"] == 1 and vocab["[MASK]"] == 2 and vocab["c00"] == 3
    assert vocab["0.0"] < vocab["0.00"] < vocab["0.01"] < vocab["0.10"] < vocab["0.1"] < vocab["0.11"] < vocab["1.0"]
    assert vocab["SHR"] == 950


def test_words_split_on_every_blank(spark):
    df = spark.createDataFrame([(" a\tb c　 d\n",)], "t string")
    assert df.select(words(F.col("t")).alias("w")).first()["w"] == ["a", "b", "c", "d"]


def test_sentence_and_block(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(row_to_sentence(["x", "y"]).alias("s")).first()["s"] == "a nan"
    ids = spark.createDataFrame([([7, 8],), (list(range(20)),)], "i array<int>").select(pad_to_block(F.col("i"), 4).alias("i"))
    assert column(ids, "i") == [[7, 8, 1, 1], [0, 1, 2, 3]]


def test_masks_per_trial(spark):
    df = spark.createDataFrame([("s", [5] * 14), ("p", [5] * 4 + [1] * 10)], "s string, ids array<int>")
    out = catmodel.mask_positions(df, ["s"], "s", "ids", 42).collect()
    per = {}
    for r in out:
        per.setdefault((r["s"], r["trial"]), set()).add(r["pos"])
    assert len(per) == 30
    assert all(len(v) == (3 if k[0] == "s" else 1) for k, v in per.items())
    assert all(max(v) <= (13 if k[0] == "s" else 4) for k, v in per.items())


def test_windows_and_complement(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    got = df.select(F.inline(feature_windows(F.col("v"), 2, 4))).collect()
    assert [(r["start"], r["inside"], r["outside"]) for r in got] == [
        (0, [1.0, 2.0], [3.0, 4.0]), (1, [2.0, 3.0], [1.0, 4.0]), (2, [3.0, 4.0], [1.0, 2.0]),
    ]
    rest = df.select(array_complement(F.col("v"), F.array(F.lit(0), F.lit(2))).alias("r")).first()["r"]
    assert rest == [2.0, 4.0]
    assert [window_width(d) for d in (40, 41, 160, 161)] == [2, 10, 10, 11]


def test_contrastive_loss(spark):
    q, k, tau = [[1.0, 0.0], [0.0, 1.0]], [[0.6, 0.8], [0.8, 0.6]], 0.5
    df = spark.createDataFrame([(q, k)], "q array<array<double>>, k array<array<double>>")
    got = df.select(contrastive_loss(F.col("q"), F.col("k"), tau).alias("s")).first()["s"]
    logits = [[sum(a * b for a, b in zip(x, y)) / tau for y in k] for x in q]
    want = sum(math.log(sum(map(math.exp, z))) - z[i] for i, z in enumerate(logits)) / 2
    assert got == pytest.approx(want)


def test_nan_to_num(spark):
    big = 1.7976931348623157e308
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.0,)], "x double")
    assert column(df.select(rows.nan_to_num(F.col("x")).alias("y")), "y") == [0.0, big, -big, 0.0, 2.0]


def test_strict_and_lenient_cast(spark):
    df = spark.createDataFrame([("1.5",), ("x",)], "t string")
    assert column(rows.cast_numeric(df, ["t"], strict=False), "t") == [1.5, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        rows.cast_numeric(df, ["t"]).collect()


def test_raw_log_folders(spark, tmp_path):
    fields = [str(i) for i in range(24)]
    (tmp_path / "2006" / "11").mkdir(parents=True)
    (tmp_path / "2006" / "11" / "day").write_text("\t".join(fields) + "\n")
    row = tables.scan_raw_log(spark, str(tmp_path)).first()
    assert row["0"] == "0" and row["17"] == "17" and row["18"] == "2006_11_22" and row["19"] == "23"
    assert (row["year"], row["month"]) == (2006, 11)


def test_yearly_files(spark, tmp_path):
    root = tmp_path / "subset"
    for year in (2006, 2007):
        spark.createDataFrame([(str(year),)], "a string").write.parquet(str(root / f"{year}_subset.parquet"))
    got = tables.scan_year_files(spark, str(tmp_path), [2006, 2007], "subset", False, "a string").collect()
    assert sorted((r["a"], r["year"], r["part"]) for r in got) == [("2006", 2006, "train"), ("2007", 2007, "train")]


def test_equal_rows_are_tokenised_apart(spark):
    df = spark.createDataFrame([("k", "0 1"), ("k", "0 1"), ("j", ""), ("m", " a  b c d e"), ("n", None)], "k string, s string")
    got = tokens.tokenize_sentences(df, ["k"], "s", tokens.vocab_generate(spark), 4).collect()
    ids = sorted((r["k"], list(r["input_ids"]), list(r["attention_mask"])) for r in got)
    assert ids == [
        ("j", [1, 1, 1, 1], [0, 0, 0, 0]), ("k", [837, 838, 1, 1], [1, 1, 0, 0]), ("k", [837, 838, 1, 1], [1, 1, 0, 0]),
        ("m", [0, 0, 0, 0], [1, 1, 1, 1]), ("n", [1, 1, 1, 1], [0, 0, 0, 0]),
    ]


@pytest.mark.parametrize("whitespace", [True, False])
def test_bad_lines_fail_or_are_kept_apart(spark, tmp_path, whitespace):
    mark = "  " if whitespace else ","
    lines = [mark.join(x) for x in (("1", "2.5", "3"), ("1", "oops", "3"), ("7",), ("1", "2", "3", "4"), ("4", "5", "6"))]
    (tmp_path / "f.txt").write_text("\n".join(lines) + "\n")
    schema = spark.createDataFrame([], "a int, b double, c int").schema
    with pytest.raises(Exception, match="bad line|MALFORMED|FAILED_READ_FILE"):
        tables.scan_delimited(spark, str(tmp_path), schema, whitespace).collect()
    got = tables.scan_delimited(spark, str(tmp_path), schema, whitespace, lenient=True).collect()
    good = sorted(tuple(r)[:3] for r in got if r["_bad_record"] is None)
    assert good == [(1, 2.5, 3), (4, 5.0, 6)]
    assert sorted(r["_bad_record"] for r in got if r["_bad_record"] is not None) == sorted(lines[1:4])
    assert all(r["a"] is None for r in got if r["_bad_record"] is not None)


def test_a_stream_scores_with_parameters_fitted_once(spark, tmp_path):
    """Three files, one per trigger: the fitted numbers do not follow what is fitted on."""
    from tidemark.streaming.yearly import stream_score

    train, source = str(tmp_path / "train"), str(tmp_path / "in")
    spark.createDataFrame([(float(i),) for i in range(10)], "x double").write.parquet(train)
    for i in range(3):
        spark.createDataFrame([(float(i),)], "x double").coalesce(1).write.mode("append").parquet(source)
    params = encoding.std_params(spark.read.parquet(train), ["x"])
    spark.createDataFrame([(1e6,)], "x double").write.mode("append").parquet(train)
    rows = spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(source)
    got = sorted((r["x"], round(r["score"], 6)) for r in stream_score(rows, ["x"], params).collect())
    std = (sum((i - 4.5) ** 2 for i in range(10)) / 10) ** 0.5
    assert got == [(float(i), round(abs(i - 4.5) / std, 6)) for i in range(3)]


def test_running_table_that_drops_repeats_step_by_step(spark):
    rng = random.Random(6)
    table = [(rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 2, 3, 4])) for _ in range(60)]
    table += [(s, f"only{s}", s or 0) for s in (None, 3)] + [(2, "hot", 1)] * 500 + [(5, "hot", 1)]
    running = []
    for step in [None, 1, 2, 3, 4, 5, 6]:
        running += [r for r in table if r[0] == step]
        values = [r[1:] for r in running]
        running = [r for r in running if values.count(r[1:]) == 1]
    df = spark.createDataFrame(table, "month int, kind string, size int")
    got = [(r.month, r.kind, r["size"]) for r in rows.distinct_none_in_steps(df, "month").collect()]
    assert sorted(got, key=str) == sorted(running, key=str) and (5, "hot", 1) in got
    assert rows.distinct_none_in_steps(df.limit(0), "month").count() == 0
