"""Approximate k-nearest-neighbour join by hashed buckets.

A table of random directions gives each vector one sign per direction; the signs are its bucket. Each of
several tables also probes the buckets behind the signs that were closest to flipping. Two
vectors meet if they share a bucket in some table; numpy compares blocks of one bucket, so only k rows
per query and block leave a task. ``knn_join`` is the exact join to measure recall against.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.neighbours import joined, nearest_in_block, packed, unpacked
from tidemark.sources.staging import stage


def directions(dim: int, tables: int, bits: int, seed: int = 7) -> np.ndarray:
    """(tables, bits, dim) normal directions from md5, the same on every machine."""

    def unit(*parts) -> float:
        digest = hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()
        return (int(digest[:8], 16) + 0.5) / 4294967296.0

    def normal(*at) -> float:
        return math.sqrt(-2.0 * math.log(unit(*at, "u"))) * math.cos(2.0 * math.pi * unit(*at, "v"))

    return np.array([[[normal(t, b, d) for d in range(dim)] for b in range(bits)] for t in range(tables)])


def bucket_of(x: np.ndarray, planes: np.ndarray, probes: int = 0) -> np.ndarray:
    """(rows, tables * (1 + probes)) bucket numbers; probes flip the signs nearest to zero, one at a time."""
    out = []
    for t, table in enumerate(planes):
        along = x @ table.T
        weight = 1 << np.arange(table.shape[0], dtype=np.int64)
        own = (along >= 0) @ weight
        out.append(own + (t << table.shape[0]))
        near = np.argsort(np.abs(along), axis=1, kind="stable")[:, :probes]
        for p in range(near.shape[1]):
            out.append((own ^ weight[near[:, p]]) + (t << table.shape[0]))
    return np.stack(out, axis=1)


def bits_for(rows: int, bucket_rows: int) -> int:
    """Signs per table, so that a bucket is expected to hold ``bucket_rows`` rows; grows with the table."""
    return max(1, math.ceil(math.log2(max(rows / bucket_rows, 2))))


def knn_buckets(
    queries: DataFrame, train: DataFrame, k: int, id_col: str, vector: str, exclude_self: bool = False,
    tables: int = 8, probes: int = 2, bits: int | None = None, bucket_rows: int = 1000, block_rows: int = 4096, seed: int = 7,
) -> DataFrame:
    """(id, neighbour, dist, rank): the k nearest train rows among those that share a bucket; distances are exact.

    Vectors are centred at the train mean before hashing, or all would lie on one side. A hot bucket is cut
    into blocks on both sides; every block pair is a group of its own. A query whose buckets hold fewer than k
    train rows has fewer neighbours. Null vectors are left out.
    """
    train = train.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vec")).filter("vec IS NOT NULL")
    queries = queries.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vec")).filter("vec IS NOT NULL")
    id_type = dict(train.dtypes)["id"]
    first = train.agg(F.count(F.lit(1)).alias("n"), F.first(F.size("vec")).alias("dim")).first()
    dim = first["dim"] or 0
    at = [F.avg(F.get("vec", F.lit(i))).alias(f"m{i}") for i in range(dim)]
    middle = np.array(train.agg(*at).first() if dim else [], dtype=float)  # one number per position
    planes = directions(dim, tables, bits or bits_for(first["n"], bucket_rows), seed)

    def hashed(rows: DataFrame, probes: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.array(pdf["vec"].tolist(), dtype=float)
                    found = bucket_of(x - middle, planes, probes)
                    yield pd.DataFrame({"id": pdf["id"], "vec": packed(x), "bucket": list(found)})

        return rows.mapInPandas(run, f"id {id_type}, vec binary, bucket array<long>")

    def each_bucket(rows: DataFrame) -> DataFrame:
        return rows.select("id", "vec", F.explode("bucket").alias("bucket"))

    # a vector is written once here, not once per bucket
    left = each_bucket(stage(hashed(queries, probes), "bucket_queries"))
    right = each_bucket(stage(hashed(train, 0), "bucket_rows"))
    sizes = right.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("tbs"))
    asked = left.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("qbs"))
    cuts = stage(sizes.join(asked, "bucket"), "bucket_sizes")  # buckets without a query or a row go here

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    spread = F.xxhash64("id")
    left = left.join(cuts, "bucket").withColumn("qb", F.pmod(spread, F.col("qbs"))).withColumn("tb", every("tbs"))
    renamed = cuts.select(F.col("bucket").alias("_b"), F.col("tbs").alias("_t"), F.col("qbs").alias("_q"))
    right = right.join(renamed, F.col("bucket") == F.col("_b"))
    right = right.withColumn("tb", F.pmod(spread, F.col("_t"))).withColumn("qb", every("_q"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": a["id"][:0], "neighbour": b["id"][:0], "dist": np.empty(0)})
        qid, tid = a["id"].to_numpy(), b["id"].to_numpy()
        q, t = (unpacked(joined(x["vec"].tolist()), len(x), dim) for x in (a, b))
        r, c, dist = nearest_in_block(qid, q, tid, t, k, exclude_self)
        return pd.DataFrame({"id": qid[r], "neighbour": tid[c], "dist": dist})

    keys = ["bucket", "tb", "qb"]
    pairs = left.select("id", "vec", *keys).groupBy(*keys).cogroup(right.select("id", "vec", *keys).groupBy(*keys))
    found = pairs.applyInPandas(compare, f"id {id_type}, neighbour {id_type}, dist double")
    found = found.groupBy("id", "neighbour").agg(F.min("dist").alias("dist"))  # met in several tables
    nearest = F.row_number().over(W.partitionBy("id").orderBy("dist", "neighbour"))
    return found.withColumn("rank", nearest).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row, (recall, pairs): share of the exact (id, neighbour) pairs that were found."""
    hit = found.select("id", "neighbour", F.lit(1).alias("_hit"))
    met = exact.select("id", "neighbour").join(hit, ["id", "neighbour"], "left")
    return met.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("pairs"))
