"""Exact k-nearest-neighbour join and the scores built on it.

Train rows are put in the cell of their nearest pivot; the number of pivots grows with the table. The
pivots' nearest rows bound the k-th distance of every query. Both tables are packed into blocks of
bounded size, train rows in the order of their cells. Groups of blocks meet pair by pair, so a vector is
shuffled once per group of the other table, not once per cell it visits. A task keeps the
k nearest rows so far of its queries; by the triangle inequality they rule out cells that cannot hold
a nearer row, and numpy compares the rest. In many dimensions distances are alike and few cells can be ruled out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.hashing import seeded_hash
from tidemark.operators.ordering import join_same
from tidemark.sources.staging import stage, unstage

PIVOT_SEED = 7
MIN_PIVOTS, MAX_PIVOTS = 32, 4096
CELLS = 1 << 20  # numbers of a matrix that a task holds at once
CELLS_OF_BLOCK = 256  # cells of a block that are ruled out one by one; of more, neighbours together
FILES = 4096  # most files of packed blocks
HELD = 256  # blocks of queries whose nearest rows a task keeps at once
TASKS_PER_CORE = 4
GROUP_ROWS = 1 << 16  # rows of a group of blocks


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(squared, 0.0))


def _pieces(pdf: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """Runs of rows that make a matrix of at most CELLS numbers, ``width`` of them per row."""
    step = max(1, CELLS // max(1, width))
    for start in range(0, len(pdf), step):
        yield pdf.iloc[start : start + step]


def nearest_in_block(qid, q, tid, t, k: int, exclude_self: bool, chunk: int = 256):
    """Indices (query, train) and distances of the k nearest train rows of each query.

    The matrix product only shortlists; shortlisted distances are recomputed by direct
    differences. Ties go to the smaller train id.
    """
    rows, cols, dists = [], [], []
    size = (q * q).sum(1).max(initial=0.0) + (t * t).sum(1).max(initial=0.0)
    slack = 1e-12 * (1.0 + size)
    for start in range(0, len(q), chunk):
        part = q[start : start + chunk]
        approx = (part * part).sum(1)[:, None] + (t * t).sum(1)[None, :] - 2.0 * part @ t.T
        if exclude_self:
            approx[qid[start : start + chunk][:, None] == tid[None, :]] = np.inf
        kth = min(k, approx.shape[1]) - 1
        limit = np.partition(approx, kth, axis=1)[:, kth]
        r, c = np.nonzero((approx <= limit[:, None] + slack) & np.isfinite(approx))
        exact = np.empty(len(r))
        most = max(1, CELLS // max(1, q.shape[1]))
        for s in range(0, len(r), most):
            piece = slice(s, s + most)
            exact[piece] = ((part[r[piece]] - t[c[piece]]) ** 2).sum(1)
        order = np.lexsort((tid[c], exact, r))
        r, c, exact = r[order], c[order], exact[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        keep = rank < k
        rows.append(r[keep] + start)
        cols.append(c[keep])
        dists.append(np.sqrt(exact[keep]))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def packed(matrix: np.ndarray) -> list[bytes]:
    """Each row in 4 bytes a number if that loses nothing, otherwise in 8."""
    with np.errstate(over="ignore"):
        short = matrix.astype(np.float32)
    exact = (short.astype(np.float64) == matrix).all(1)
    return [(short if e else matrix)[i].tobytes() for i, e in enumerate(exact)]


def joined(rows: list[bytes]) -> bytes:
    """Packed rows as one packed matrix."""
    width = max(map(len, rows))
    return b"".join(r if len(r) == width else np.frombuffer(r, np.float32).astype(np.float64).tobytes() for r in rows)


def unpacked(data, rows: int, dim: int) -> np.ndarray:
    short = len(data) == 4 * rows * dim
    return np.frombuffer(data, np.float32 if short else np.float64).reshape(rows, dim).astype(np.float64)


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of all batches in tables of ``rows``; the last one may have fewer."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            n %= rows
            for at in range(0, table.num_rows - n, rows):
                yield table.slice(at, rows)
            held = table.slice(table.num_rows - n).to_batches()
    if n:
        yield pa.Table.from_batches(held)


def _block(ids: pa.Array, vecs: list[bytes], extra: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """One row: all ids, their packed vectors, and a number for each."""
    columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), [joined(vecs)], [extra.tobytes()]]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.binary()) for c in columns], names)


def _values(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether null); the value of a null has no meaning."""
    void = ids.is_null().to_numpy(zero_copy_only=False)
    if void.any():
        known = ids.drop_null()
        ids = pc.fill_null(ids, known[0]) if len(known) else pa.array(np.zeros(len(ids), np.int64))
    return ids.to_numpy(zero_copy_only=False), void


def _enough_copies(ids: pa.Array, vecs: list[bytes], k: int) -> np.ndarray:
    """Places of the rows that can be among the k nearest of any query, its own id excluded: of equal vectors the smallest ids."""
    value, void = _values(ids)
    rows = pd.DataFrame({"vec": vecs, "id": value, "void": void})
    if not rows["vec"].duplicated().any():
        return np.arange(len(vecs))
    rows = rows.sort_values(["void", "id"], ascending=[False, True], kind="stable")
    same_id = rows.groupby(["vec", "id"])["id"].transform("size").groupby(rows["vec"]).transform("max")
    return np.sort(rows.index[rows.groupby("vec").cumcount() < k + same_id].to_numpy())


class _Nearest:
    """The k nearest rows, of those met so far, of each query of a block; ties go to the smaller id."""

    def __init__(self, ids: pa.Array, bound: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.k, self.exclude_self = ids, k, exclude_self
        self.value, self.void = _values(ids)
        self.bound = bound.copy()  # no row farther away is among the k nearest
        self.row, self.dist, self.near, self.near_void = np.zeros(0, np.int64), np.zeros(0), None, np.zeros(0, bool)

    def meet(self, q: np.ndarray, ids: pa.Array, t: np.ndarray, cell: np.ndarray) -> None:
        """``t``: train vectors in the order of their cells."""
        value, void = _values(ids)
        starts = np.append(0, np.flatnonzero(np.diff(cell)) + 1)
        starts = starts[:: -(-len(starts) // CELLS_OF_BLOCK)]
        sizes = np.diff(np.append(starts, len(t)))
        middle = np.add.reduceat(t, starts, axis=0) / sizes[:, None]
        radius = np.maximum.reduceat(np.sqrt(((t - np.repeat(middle, sizes, axis=0)) ** 2).sum(1)), starts)
        scale = math.sqrt((q * q).sum(1).max() + (t * t).sum(1).max())
        open_ = _distances(q, middle) - radius <= self.bound[:, None] * (1 + 1e-9) + 1e-6 * (1 + scale)
        if open_.mean() > 0.5:
            self._search(np.flatnonzero(open_.any(1)), q, value, void, t)
            return
        for i, (start, n) in enumerate(zip(starts, sizes)):
            part = slice(start, start + n)
            self._search(np.flatnonzero(open_[:, i]), q, value[part], void[part], t[part])

    def _search(self, rows, q, value, void, t, chunk: int = 256) -> None:
        """The matrix product only shortlists; shortlisted distances are recomputed by direct differences."""
        if not len(rows):
            return
        need = self.k
        if self.exclude_self:  # rows of the query's id are met as well and left out below
            ids, times = np.unique(value[~void], return_counts=True)
            need += int(times[np.isin(ids, self.value)].max(initial=0))
        found = [(self.row, self.dist, self.near, self.near_void)] if self.near is not None else []
        square = (t * t).sum(1)
        most = max(1, CELLS // max(1, t.shape[1]))
        for at in range(0, len(rows), chunk):
            r = rows[at : at + chunk]
            part = q[r]
            own = (part * part).sum(1)
            i, c = self._shortlist(part, own, self.bound[r] ** 2, t, square, need)
            if self.exclude_self:
                other = (self.value[r[i]] != value[c]) | self.void[r[i]] | void[c]
                i, c = i[other], c[other]
            dist = np.empty(len(i))
            for s in range(0, len(i), most):
                piece = slice(s, s + most)
                dist[piece] = np.sqrt(((part[i[piece]] - t[c[piece]]) ** 2).sum(1))
            best, _ = self._best(i, dist, value[c], void[c])
            found.append((r[i[best]], dist[best], value[c[best]], void[c[best]]))
        each = [np.concatenate(c) for c in zip(*found)]
        best, rank = self._best(*each)
        self.row, self.dist, self.near, self.near_void = (c[best] for c in each)
        last = rank == self.k - 1
        self.bound[self.row[last]] = np.fmin(self.bound[self.row[last]], self.dist[last])

    def _shortlist(self, part, own, limit, t, square, need):
        """(query, train row) of all pairs within the limits of the squared distances, and few others.

        Tight limits are tried in single precision, with its error added to them; where that leaves
        many rows, and for wide limits, double precision decides.
        """
        size = own + square.max()
        if 1e-20 < size.min() and size.max() < 1e30 and np.isfinite(limit).all():
            slack = (t.shape[1] + 16) * 2.0**-22 * size
            approx = part.astype(np.float32) @ (-2.0 * t.T).astype(np.float32)
            approx += square.astype(np.float32)
            hit = np.flatnonzero(approx <= (limit - own + slack).astype(np.float32)[:, None])
            if len(hit) <= 2 * need * len(part):
                return np.divmod(hit, len(t))
        slack = 1e-12 * (1.0 + size)
        approx = part @ (-2.0 * t.T)
        approx += square
        hit = approx <= (limit - own + slack)[:, None]
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * need)
        if len(many) and need <= len(t):
            kth = np.partition(approx[many], need - 1, axis=1)[:, need - 1]
            hit[many] &= approx[many] <= (kth + 2 * slack[many])[:, None]
        return np.divmod(np.flatnonzero(hit), len(t))

    def _best(self, row, dist, near, near_void):
        """(places, rank) of the k nearest of each query."""
        order = np.lexsort((near, ~near_void, dist, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = (rank < self.k) & np.isfinite(dist[order])
        return order[keep], rank[keep]

    def found(self, id_type: pa.DataType) -> pa.RecordBatch:
        near = pa.nulls(0, id_type) if self.near is None else pa.array(self.near, mask=self.near_void).cast(id_type)
        columns = [self.ids.take(pa.array(self.row)), near, pa.array(self.dist)]
        return pa.RecordBatch.from_arrays(columns, ["id", "neighbour", "dist"])


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    id_col: str,
    vector: str,
    exclude_self: bool = False,
    pivots: int | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """(id, neighbour, dist, rank): the exact k nearest train rows of every query.

    Vectors with infinite or undefined numbers are no neighbours and have none.
    """
    spark = train.sparkSession
    train = train.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    queries = queries.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    id_type = dict(train.dtypes)["id"]
    n_train, n_queries = train.count(), queries.count()
    if pivots is None:
        pivots = int(min(MAX_PIVOTS, max(MIN_PIVOTS, math.sqrt(n_train))))
    # at most `pivots` vectors and `pivots * (k + 1)` distances reach the driver
    chosen = train.orderBy(seeded_hash(PIVOT_SEED, "id"), "id").limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], f"id {id_type}, neighbour {id_type}, dist double, rank int")
    centres = np.array([r["vec"] for r in chosen], dtype=np.float64)
    dim = centres.shape[1]
    centres = np.where(np.isfinite(centres).all(1)[:, None], centres, 0.0)
    need = k + 1 if exclude_self else k

    def to_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _pieces(batch, dim):
                vecs = _matrix(pdf["vec"])
                whole = np.isfinite(vecs).all(1)
                yield pd.DataFrame({"id": pdf["id"][whole], "vec": packed(vecs[whole])})

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in to_rows(batches):
            for piece in _pieces(pdf, len(centres)):
                d = _distances(unpacked(joined(piece["vec"].tolist()), len(piece), dim), centres)
                yield piece.assign(cell=d.argmin(1).astype("int32"), reach=d.min(1))

    cells = stage(train.mapInPandas(to_cells, f"id {id_type}, vec binary, cell int, reach double"), "cells")
    closest = W.partitionBy("cell").orderBy("reach", "id")
    inner = cells.select("id", "cell", "reach", F.row_number().over(closest).alias("r")).filter(F.col("r") <= need)
    inner = inner.collect()
    near_cell = np.array([r["cell"] for r in inner], dtype=np.int64)
    near_reach = np.array([r["reach"] for r in inner], dtype=np.float64)
    own: dict = {}  # places of an id in these lists
    for i, r in enumerate(inner if exclude_self else []):
        own.setdefault(r["id"], []).append(i)

    def bounds(ids: list, vecs: np.ndarray) -> np.ndarray:
        """Distance within which each query has k rows, by way of the pivots."""
        out = np.full(len(ids), np.inf)
        step = max(1, CELLS // max(1, len(near_cell)))
        for at in range(0, len(ids) if len(near_cell) >= k else 0, step):
            part = vecs[at : at + step]
            upper = _distances(part, centres)[:, near_cell] + near_reach[None, :]
            for i, x in enumerate(ids[at : at + step]):
                upper[i, own.get(x, [])] = np.inf
            scale = np.sqrt((part * part).sum(1) + (centres * centres).sum(1).max())
            out[at : at + step] = np.partition(upper, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-6 * (1 + scale)
        return out

    def to_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, block_rows):
            ids, vecs = table.column("id").combine_chunks(), table.column("vec").to_pylist()
            far = bounds(ids.to_pylist() if own else [None] * len(ids), unpacked(joined(vecs), len(ids), dim))
            yield _block(ids, vecs, far, ["id", "vec", "bound"])

    def to_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, block_rows):
            ids, vecs = table.column("id").combine_chunks(), table.column("vec").to_pylist()
            use = _enough_copies(ids, vecs, k)
            cell = table.column("cell").to_numpy()[use]
            yield _block(ids.take(pa.array(use)), [vecs[i] for i in use], cell, ["t_id", "t_vec", "t_cell"])

    def files(rows: int, blocks: int) -> int:
        return max(1, min(FILES, -(-rows // (blocks * block_rows))))

    held = cells.repartitionByRange(files(n_train, 4), "cell", "reach", "id").sortWithinPartitions("cell", "reach", "id")
    held = held.mapInArrow(to_held, f"t_id array<{id_type}>, t_vec binary, t_cell binary")
    held = stage(held.withColumn("t_block", F.monotonically_increasing_id()), "held_blocks")
    asked = queries.mapInPandas(to_rows, f"id {id_type}, vec binary").repartition(files(n_queries, 1))
    asked = asked.mapInArrow(to_asked, f"id array<{id_type}>, vec binary, bound binary")
    asked = stage(asked.withColumn("block", F.monotonically_increasing_id()), "asked_blocks")
    unstage(cells)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, _Nearest] = {}
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                block, ids, t_ids = column["block"][i].as_py(), column["id"][i].values, column["t_id"][i].values
                if block not in kept:
                    if len(kept) >= HELD:
                        yield kept.pop(next(iter(kept))).found(ids.type)
                    far = np.frombuffer(column["bound"][i].as_buffer(), np.float64)
                    kept[block] = _Nearest(ids, far, k, exclude_self)
                q = unpacked(column["vec"][i].as_buffer(), len(ids), dim)
                t = unpacked(column["t_vec"][i].as_buffer(), len(t_ids), dim)
                kept[block].meet(q, t_ids, t, np.frombuffer(column["t_cell"][i].as_buffer(), np.int32))
        for nearest in kept.values():
            yield nearest.found(nearest.ids.type)

    # groups of blocks on both sides, met pair by pair: each table is shuffled once per group of the other
    few = math.ceil(math.sqrt(TASKS_PER_CORE * spark.sparkContext.defaultParallelism))

    def groups(rows: int) -> int:
        return max(-(-rows // GROUP_ROWS), min(few, -(-rows // block_rows)), 1)

    n, m = groups(n_queries), groups(n_train)
    parts = min(n * m, FILES)
    left = asked.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(n)))
    left = left.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).repartition(parts, "g", "h")
    right = held.withColumn("_h", F.pmod(F.xxhash64("t_block"), F.lit(m)).cast("int"))
    right = right.withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).repartition(parts, "_g", "_h")
    pairs = left.join(right, (F.col("g") == F.col("_g")) & (F.col("h") == F.col("_h"))).drop("g", "h", "_g", "_h", "t_block")
    found = pairs.mapInArrow(compare, f"id {id_type}, neighbour {id_type}, dist double")
    nearest = F.row_number().over(W.partitionBy("id").orderBy("dist", "neighbour"))
    return found.withColumn("rank", nearest).filter(F.col("rank") <= k)


def knn_distance(queries, train, k, id_col, vector, exclude_self=False, **blocks) -> DataFrame:
    """(id, score): mean distance to the k nearest train rows."""
    near = knn_join(queries, train, k, id_col, vector, exclude_self, **blocks)
    return near.groupBy("id").agg(F.avg("dist").alias("score"))


def fit_lof(train: DataFrame, k: int, id_col: str, vector: str, **blocks) -> DataFrame:
    """(neighbour, k_dist, n_lrd) of every train row: its k-distance and its density, 1 / (mean reach-distance + 1e-10)."""
    own = stage(knn_join(train, train, k, id_col, vector, exclude_self=True, **blocks), "own_neighbours")
    k_dist = stage(own.groupBy(F.col("id").alias("neighbour")).agg(F.max("dist").alias("k_dist")), "k_dist")
    reached = join_same(own, k_dist, ["neighbour"], "left").groupBy("id").agg(_density().alias("n_lrd"))
    return stage(join_same(k_dist, reached.withColumnRenamed("id", "neighbour"), ["neighbour"]), "density")


def _density():
    return 1.0 / (F.avg(F.greatest("k_dist", "dist")) + 1e-10)


def score_lof(queries: DataFrame, train: DataFrame, density: DataFrame, k: int, id_col: str, vector: str, **blocks) -> DataFrame:
    """(id, score): local outlier factor of each query against train rows with their fitted ``density``."""
    near = join_same(knn_join(queries, train, k, id_col, vector, **blocks), density, ["neighbour"], "left")
    return near.groupBy("id").agg((F.avg("n_lrd") / _density()).alias("score"))


def lof(queries: DataFrame, train: DataFrame, k: int, id_col: str, vector: str, **blocks) -> DataFrame:
    """(id, score): local outlier factor of each query against the train rows.

    k-distance, reach-distance and density follow the published definition with exactly
    k neighbours.
    """
    return score_lof(queries, train, fit_lof(train, k, id_col, vector, **blocks), k, id_col, vector, **blocks)
