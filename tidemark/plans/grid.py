"""Queries: detectors, fitted once, over every test year; their metrics and averages per split."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import centre, detectors, encoding, metrics, tails
from tidemark.plans.detect import CAT, D, NUM, centre_body, forest_body, kept, pca_body, rff_body, sparse_rff_body, tail_body
from tidemark.plans.evaluate import rounded
from tidemark.plans.flow import flow, labelled, training
from tidemark.plans.registry import Z_SQL, long_metrics, metrics_sql, query, with_flow
from tidemark.plans.language import IID_SQL
from tidemark.sources.staging import new_path, stage

BY = ["method", "year", "split"]
CARRIED = ["year", "split", "label"]


def detector_scores(train: DataFrame, test: DataFrame) -> DataFrame:
    """(method, year, split, label, score) of every test row under every detector; each is fitted once, on ``train``."""
    model = tails.TailModel(train, NUM, CAT)
    spread = encoding.std_params(train, NUM)
    robust = encoding.robust_params(train, NUM)
    scale = lambda df: encoding.robust_scale(df, NUM, robust)
    scored = {
        "ecod": model.score(test, "ecod"),
        "copod": model.score(test, "copod"),
        "max_abs_z": encoding.max_abs_z(test, NUM, spread),
        "ocsvm_rff": centre.ocsvm_rff(scale(train.select(*NUM)), scale(test.select(*CARRIED, *NUM)), NUM, D),
    }
    parts = [df.select(F.lit(m).alias("method"), *CARRIED, F.round("score", 5).alias("score")) for m, df in scored.items()]
    return reduce(DataFrame.unionByName, parts)


def scores_sql(test: str, train: str | None = None) -> str:
    """Named query ``scored``; ``train`` and ``test`` replace the tables of the out-of-distribution protocol."""
    names = (f"train AS ({train}), " if train else "") + f"test AS ({test})"
    bodies = {"ecod": tail_body("ecod"), "copod": tail_body("copod"), "max_abs_z": Z_SQL + " SELECT row_key, score FROM z", "ocsvm_rff": rff_body()}
    each = "".join(f", {m}_s AS (WITH {names}{body})" for m, body in bodies.items())
    union = " UNION ALL ".join(
        f"SELECT '{m}' AS method, year, split, label, round(score, 5) AS score FROM {m}_s JOIN ({test}) t USING (row_key)" for m in bodies
    )
    return f"{each}, scored AS ({union})" + metrics_sql("method, year, split") + long_metrics("method, year, split")


AVERAGES = " SELECT method, split, metric, round(avg(value), 4) AS value, count(value) AS n_years FROM metrics GROUP BY 1, 2, 3"
OOD_TEST = "SELECT * FROM flow WHERE split IN ('IID', 'NEAR', 'FAR')"
ID_TRAIN = "SELECT * FROM flow WHERE part = 'train' AND label = 0"
ID_TEST = "SELECT * REPLACE ('IID' AS split) FROM flow WHERE part = 'valid'"


def grid(train: DataFrame, test: DataFrame) -> DataFrame:
    return metrics.eval_grid(stage(detector_scores(train, test), "detector_scores"), BY)


@query("detector_grid", with_flow(scores_sql(OOD_TEST) + " SELECT method, year, split, metric, round(value, 4) AS value FROM metrics"))
def detector_grid(spark, sf_dir):
    base = flow(spark, sf_dir)
    return rounded(grid(training(base), kept(base)), "value", digits=4)


@query("detector_averages", with_flow(scores_sql(OOD_TEST) + AVERAGES))
def detector_averages(spark, sf_dir):
    base = flow(spark, sf_dir)
    return rounded(metrics.split_macro_avg(grid(training(base), kept(base))), "value", digits=4)


@query("in_distribution_grid", with_flow(scores_sql(ID_TEST, ID_TRAIN) + " SELECT method, year, split, metric, round(value, 4) AS value FROM metrics"))
def in_distribution_grid(spark, sf_dir):
    """Train on the train parts of all years, evaluate on the held-out part of each."""
    rows = labelled(flow(spark, sf_dir)).withColumn("split", F.lit("IID"))
    train = rows.filter("part = 'train' AND label = 0")
    test = rows.filter("part = 'valid'").select("row_key", "copy_id", "year", "split", "label", *NUM, *CAT)
    return rounded(grid(train, test), "value", digits=4)


# --- detectors by name, from saved models ----------------------------------------------

SAVED = {  # categories and digits of the score; rounded once, as a second rounding would move scores that end in 5
    "ecod": (CAT, 5), "copod": (CAT, 5), "isolation_forest": ((), 6), "pca": ((), 5), "kernel": (CAT, 6), "centre": ((), 6),
    "max_abs_z": ((), 5), "count_model": (CAT, 9),
}


def saved_scores(spark, train: DataFrame, test: DataFrame) -> DataFrame:
    """(method, year, split, label, score): every detector fitted by name, saved, loaded again and applied to all test rows."""

    def one(name: str) -> DataFrame:
        path, (cats, digits) = new_path(spark, f"model-{name}"), SAVED[name]
        detectors.fit(name, train, () if name == "count_model" else NUM, cats).save(path)
        scored = detectors.load(spark, path).score(test)
        return scored.select(F.lit(name).alias("method"), *CARRIED, F.round("score", digits).alias("score"))

    # the detectors do not depend on each other: small jobs of one fill the gaps of another
    with ThreadPoolExecutor(len(SAVED)) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, SAVED))


def saved_sql() -> str:
    bodies = {
        "ecod": tail_body("ecod"), "copod": tail_body("copod"), "isolation_forest": forest_body(), "pca": pca_body(),
        "kernel": sparse_rff_body(), "centre": centre_body(), "max_abs_z": Z_SQL + " SELECT row_key, score FROM z",
    }
    each = "".join(f", {m}_s AS (WITH RECURSIVE test AS ({OOD_TEST}){body})" for m, body in bodies.items())
    each += f", count_model_s AS (WITH test AS ({OOD_TEST}){IID_SQL} SELECT year, split, label, score FROM scored)"
    union = " UNION ALL ".join(
        f"SELECT '{m}' AS method, year, split, label, round(score, {SAVED[m][1]}) AS score FROM {m}_s JOIN test t USING (row_key)" for m in bodies
    )
    union += f" UNION ALL SELECT 'count_model', year, split, label, round(score, {SAVED['count_model'][1]}) FROM count_model_s"
    return f"{each}, scored AS ({union})" + metrics_sql("method, year, split") + long_metrics("method, year, split")


@query("saved_detector_grid", with_flow(saved_sql() + " SELECT method, year, split, metric, round(value, 4) AS value FROM metrics"))
def saved_detector_grid(spark, sf_dir):
    base = flow(spark, sf_dir)
    scores = stage(saved_scores(spark, training(base), kept(base)), "saved_scores")
    return rounded(metrics.eval_grid(scores, BY), "value", digits=4)
