"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``. A caller writes each stage's result and hands it to the next; ``run`` does so in the
shared staging folder.
"""

from __future__ import annotations

from tidemark.llm import exact, mixing, packing, simhash, toxicity
from tidemark.llm.common import column, documents
from tidemark.sources.staging import stage


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity network, trained on the labels of this corpus, rejects go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.clean_documents(docs, labels)


def drop_exact_copies(spark, docs, sf_dir):
    """Of texts equal but for the case of A-Z the one with the largest doc_id stays."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of documents linked by fingerprints at most three bits apart the one with the smallest doc_id stays."""
    return simhash.near_dedup(docs)


def mix_sources(spark, docs, sf_dir):
    """Nine tenths of the tokens, flattened over the sources as far as no document has to repeat."""
    tokens = mixing.word_tokens(column("text"))
    return mixing.mixed_documents(docs, tokens, budget_share=0.9, entropy_share=None, max_repeats=1.0)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of training sequences of 1024 ids."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# a trained network decides the first stage, which SQL cannot express
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
