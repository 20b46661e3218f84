"""Hard-negative mining with segment summary filtering.

A vector is cut into segments; of each, the mean and the deviation are kept. The inner product of two
vectors lies within the sum over segments of (length * product of means) plus or minus (product of
deviations). Anchors are compared with all rows block by block: coarse segments give bounds for every
row, rows whose bounds rule them out go, the rest is bounded again with shorter segments, and
only what is left in the end is scored exactly. Blocks return a bounded number of rows per anchor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import column
from tidemark.llm.registry import query
from tidemark.sources.staging import stage

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score between which a negative is hard
SEGMENTS = (4, 16, 32)  # segments a vector is cut into, coarse to fine
EXACT = 2.0**53  # below it sums of integers in doubles are exact
ANCHOR_BLOCK = 512
ROW_BLOCK = 16384
TILE = 2048  # rows of a block bounded at once
TOP = np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, label, vec): rows with a label and a vector of finite numbers only, scaled and floored."""
    x = F.transform(column("embedding"), lambda v: v.cast("double"))
    # a double of 2^53 or more is whole, and floor's long would overflow
    vec = F.transform(x, lambda v: F.when(F.abs(v * scale) < EXACT, F.floor(v * scale).cast("double")).otherwise(v * scale))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.filter(column("label").isNotNull() & column("embedding").isNotNull() & usable & column("vec_id").isNotNull()).select(
        column("vec_id").cast("long").alias("id"), column("label").cast("long").alias("label"), vec.alias("vec")
    )


def mislabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Every ``every``-th id gets the next label."""
    moved = F.when(F.col("id") % every == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label"))
    return rows.withColumn("label", moved)


def summaries(m: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(means times the root of the length, deviations), one column per segment; the last one may be shorter."""
    n, width = m.shape
    size = max(1, -(-width // segments))
    starts = np.arange(0, width, size)
    length = np.diff(np.append(starts, width))
    total = np.add.reduceat(m, starts, axis=1) if width else np.zeros((n, 0))
    mean = total / length
    rest = m - np.repeat(mean, length, axis=1)
    spread = np.sqrt(np.add.reduceat(rest * rest, starts, axis=1)) if width else np.zeros((n, 0))
    return mean * np.sqrt(length), spread


def bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest possible inner product of every row of ``a`` with every row of ``b``."""
    middle, reach = a[0] @ b[0].T, a[1] @ b[1].T
    reach += 1e-9 * (np.abs(middle) + reach) + 1e-6  # rounding of the summaries
    return middle - reach, middle + reach


def exact_scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Integer inner products of the pairs; scores beyond 64 bits are an error."""
    if not len(i):
        return np.zeros(0, np.int64)
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(a.shape[1], 1)
    if most < EXACT:  # whole numbers below 2^53: exact in any order of summing
        if len(i) * 8 > len(a) * len(b):
            return (a @ b.T)[i, j].astype(np.int64)
        parts = [np.einsum("ij,ij->i", a[i[at : at + chunk]], b[j[at : at + chunk]]) for at in range(0, len(i), chunk)]
        return np.concatenate(parts).astype(np.int64)
    return np.array([sum(int(p) * int(q) for p, q in zip(a[x], b[y])) for x, y in zip(i, j)], np.int64)


def first_k(owner: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` rows of each owner: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, owner))
    sorted_owner = owner[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_owner, sorted_owner, side="left")
    return order[rank < k]


def best_in_ranges(anchors, rows, ids, excluded, floors, ceilings, k: int, segments=SEGMENTS, tile: int = TILE):
    """(anchor, range, row, score) of the first ``k`` rows of every range of scores of every anchor; and the pairs scored.

    ``floors``, ``ceilings``: one column per range. ``excluded(slice)``: matrix of pairs that don't count. Rows are taken tile
    by tile. Once a range has k rows, a row must reach the worst of them: pairs whose bounds rule out every range
    of the anchor go at the coarsest segments that show it, the rest is bounded again, and what is left is scored.
    """
    n, ranges = floors.shape
    mine = [summaries(anchors, s) for s in segments]
    least = floors.copy()  # the score a new row has to reach
    held = [[np.zeros(0, np.int64)] * 3 for _ in range(ranges)]  # anchor, row, score
    scored, highest = 0, ceilings.max(axis=1).astype(np.float64)[:, None]
    for start in range(0, len(rows), tile):
        place = slice(start, min(start + tile, len(rows)))
        part = rows[place]
        lowest = np.where(floors <= ceilings, least, TOP).min(axis=1).astype(np.float64)[:, None]
        stays = ~excluded(place)
        for level, size in enumerate(segments):
            low, high = bounds(mine[level], summaries(part, size))
            stays &= (high >= lowest) & (low <= highest)
            if not stays.any():
                break
        i, j = np.nonzero(stays)
        scored += len(i)
        score = exact_scores(anchors, part, i, j)
        j += start
        for r in range(ranges):
            use = (score >= least[i, r]) & (score <= ceilings[i, r])
            own, row, value = (np.concatenate(c) for c in zip(held[r], (i[use], j[use], score[use])))
            first = first_k(own, ids[row], value, k)
            own, row, value = own[first], row[first], value[first]
            held[r] = [own, row, value]
            full = np.bincount(own, minlength=n) >= k
            worst = np.full(n, TOP)
            np.minimum.at(worst, own, value)
            least[full, r] = worst[full]
    own, row, value = (np.concatenate([h[c] for h in held]) for c in range(3))
    return own, np.repeat(np.arange(ranges), [len(h[0]) for h in held]), row, value, scored


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _together(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.map(len).max(), b.map(len).max())
    return _matrix(a, width), _matrix(b, width)


def _block(count: str | int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(17)), F.col(count) if isinstance(count, str) else F.lit(count))


def _compared(left: DataFrame, right: DataFrame, keys: list[str], compare, schema: str) -> DataFrame:
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)


def positives(anchors: DataFrame, rows: DataFrame, k: int = POSITIVES, anchor_block=ANCHOR_BLOCK, row_block=ROW_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, positive_score, label): each anchor's best ``k`` other rows of its label.

    Anchors and rows of a label are cut into blocks of bounded size each, so a label that holds most rows lies in many tasks.
    """
    per_label = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    own = anchors.groupBy("label").agg(F.count(F.lit(1)).alias("a"))
    cuts = stage(
        per_label.join(own, "label").select(
            "label", F.ceil(F.col("n") / row_block).alias("n_blocks"), F.ceil(F.col("a") / anchor_block).alias("a_blocks")
        ),
        "label_blocks",
    )

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    left = anchors.join(cuts, "label").withColumn("ab", _block("a_blocks")).withColumn("rb", each("n_blocks"))
    same = cuts.select(F.col("label").alias("_label"), F.col("n_blocks").alias("_n"), F.col("a_blocks").alias("_a"))
    right = rows.join(same, F.col("label") == F.col("_label")).withColumn("rb", _block("_n")).withColumn("ab", each("_a"))
    names = ["anchor_id", "positive_id", "positive_score", "label"]

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        x, y = _together(a["vec"], b["vec"])
        aid, bid = a["id"].to_numpy(), b["id"].to_numpy()
        every = np.full((len(a), 1), -TOP - 1), np.full((len(a), 1), TOP)
        i, _, j, score, _ = best_in_ranges(x, y, bid, lambda at: aid[:, None] == bid[None, at], *every, k)
        return pd.DataFrame({"anchor_id": aid[i], "positive_id": bid[j], "positive_score": score, "label": a["label"].iloc[0]})

    pairs = _compared(left, right, ["label", "ab", "rb"], compare, "anchor_id long, positive_id long, positive_score long, label long")
    best = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")


def negatives(
    anchors: DataFrame, rows: DataFrame, chosen: DataFrame, k: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    anchor_block=ANCHOR_BLOCK, row_block=ROW_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the best ``k`` rows of other labels in range.

    Every anchor carries its positives' scores; every block of anchors meets every block of rows once.
    """
    wanted = chosen.groupBy(F.col("anchor_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("chosen")  # at most POSITIVES
    )
    anchors = stage(anchors.join(wanted, "id"), "anchors_with_positives")
    sizes = (anchors.count(), rows.count())
    a_blocks, n_blocks = (max(1, -(-n // block)) for n, block in zip(sizes, (anchor_block, row_block)))

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = anchors.withColumn("ab", _block(a_blocks)).withColumn("rb", each(n_blocks))
    right = rows.withColumn("rb", _block(n_blocks)).withColumn("ab", each(a_blocks))
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        x, y = _together(a["vec"], b["vec"])
        labels, own, bid = b["label"].to_numpy(), a["label"].to_numpy(), b["id"].to_numpy()
        # a range of scores per positive, in integers, so no limit is rounded; an anchor with fewer has empty ranges
        ranges = a["chosen"].map(len).max()
        floors, ceilings = np.ones((len(a), ranges), np.int64), np.zeros((len(a), ranges), np.int64)
        pid, ps = np.zeros((2, len(a), ranges), np.int64)
        for n, chosen_ in enumerate(a["chosen"]):
            for r, c in enumerate(chosen_):
                pid[n, r], ps[n, r] = c["positive_id"], c["positive_score"]
                floors[n, r], ceilings[n, r] = -(-low * int(ps[n, r]) // 100), high * int(ps[n, r]) // 100
        i, r, j, score, _ = best_in_ranges(x, y, bid, lambda at: own[:, None] == labels[None, at], floors, ceilings, k)
        return pd.DataFrame(dict(zip(names, (a["id"].to_numpy()[i], pid[i, r], ps[i, r], bid[j], score))))

    pairs = _compared(left, right, ["ab", "rb"], compare, ", ".join(f"{n} long" for n in names))
    best = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(rows: DataFrame, is_anchor: Column, **blocks) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (id, label, vec): see ``positives`` and ``negatives``.

    Scores are integer inner products; higher first, ties by smaller id. Rows must have distinct ids; repeated rows
    count each, and a row is no positive of a row with its id. Vectors of unequal length are filled with zeros.
    An empty table, or anchors without others of their label, give no rows.
    """
    rows = stage(rows, "vectors")
    anchors = stage(rows.filter(is_anchor).dropDuplicates(["id"]), "anchors")
    chosen = stage(positives(anchors, rows, **blocks), "positives")
    return negatives(anchors, rows, chosen, **blocks)


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return hard_negatives(mislabelled(whole_vectors(rows)), F.col("id") % 100 == 0)
