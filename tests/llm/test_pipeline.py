"""The pipeline's stages on documents with planted cases, and without rows."""

import corpus_pipeline
import pytest

from tests.llm.tables import empty, labels, odd, prose
from tidemark.llm import toxicity


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows, marks = [], []
    for i in range(300):
        words = prose(i, 30 + i % 70).split()
        toxic = i % 5 == 0
        if toxic:
            words[3] = "grubworm"
        rows.append((i, " ".join(words), "en", f"s{i % 2}", 1))
        if i < 270:
            marks.append((i, 1, int(toxic)))
    rows += [(500 + i, rows[i * 7 + 1][1].upper(), "en", "s0", 1) for i in range(6)]  # exact copies, but for case
    rows += [(600 + i, rows[i * 7 + 2][1] + " .", "en", "s0", 1) for i in range(6)]
    rows += [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels(spark, marks).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        before = docs
        docs = function(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id for r in docs.collect()}
    toxic = set(range(0, 300, 5))
    assert len(toxic & kept["toxicity"]) <= 6
    assert len(kept["toxicity"] - toxic) >= 230
    for i in range(6):
        pair = {i * 7 + 1, 500 + i}
        assert len(pair & kept["exact_dedup"]) == len(pair & kept["toxicity"]) - (pair <= kept["toxicity"])
    assert kept["simhash_near_dedup"] <= kept["exact_dedup"]
    assert kept["packing"] == kept["mixing"] <= kept["simhash_near_dedup"]
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_of_odd_and_empty_tables(spark, sf_dir, monkeypatch):
    scorer = toxicity.train([])
    scorer.constant = 0.1
    monkeypatch.setattr(toxicity, "fit", lambda *a: scorer)
    for docs in (odd(spark), empty(spark)):
        for _, function in corpus_pipeline.STAGES:
            docs = function(spark, docs, sf_dir)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
