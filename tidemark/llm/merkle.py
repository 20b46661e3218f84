"""Merkle dataset manifest: a tree per source, a tree over the sources, climbed by a recursive query.

Rows are numbered by one range shuffle. Levels are built bottom-up in blocks of 3^stride neighbours, so
n rows take log(n) / stride passes and no block is larger, whatever the source. The built levels are stored
as node rows: the node, its ancestor ``stride`` levels up (its parent, in the stored tree), and the siblings
met on the way. A recursive query then climbs per leaf from row to parent row, appends the siblings
and folds the tampered hash.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import column, documents, small_batches
from tidemark.llm.mixing import source_key
from tidemark.llm.registry import query
from tidemark.sources.staging import stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
STRIDE = 6  # levels between stored nodes: blocks of 729
ROOT = "/"  # the tree over the sources; those of sources are named "" (null) or "=..."
ROW_BITS = 33  # of monotonically_increasing_id: the place within the partition


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(values: dict[str, Column]) -> Column:
    """Hex SHA-256 of the fields of a row, in the order of ``FIELDS``."""
    return digest(F.concat(*[field(values[c]) for c in FIELDS]))


def hashed_rows(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered) of every row; hashes in binary. Null ids are never tampered with."""
    values = {c: column(c) for c in FIELDS}
    hit = F.crc32(column("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(hit, F.replace(values["text"], F.lit("\n"), F.lit(""))).otherwise(values["text"])
    return docs.select(
        source_key(column("source")).alias("tree"),
        column("doc_id").alias("doc_id"),
        F.unhex(leaf_hash(values)).alias("leaf"),
        F.unhex(leaf_hash(values | {"text": changed})).alias("tampered"),
    )


def numbered(rows: DataFrame, group: str, order: tuple[str, ...]) -> DataFrame:
    """Add ``idx`` (from 0, in ``order`` within ``group``) and ``n`` (rows of the group); ``group`` is never null.

    One range shuffle; the counts of each group and partition give its offset. No step orders a group in one task.
    """
    part = F.shiftright("_row", ROW_BITS)
    cut = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    cut = stage(cut.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", part), "numbered")
    slices = cut.groupBy(group, "_part").agg(F.min("_row").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(  # partitions + groups rows
        group, "_part", "_low",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(group)).alias("n"),
    )
    met = cut.join(stage(slices, "slices"), [group, "_part"])
    return met.withColumn("idx", F.col("_row") - F.col("_low") + F.col("_before")).drop("_row", "_part", "_low", "_before")


def block_levels(hashes: list[str], climbs: int) -> tuple[list[list[tuple[bytes, bytes]]], str]:
    """(per level the siblings left and right of each node, the hash on top) of a block that climbs so many levels."""
    levels, current = [], hashes
    for _ in range(climbs):
        raw = [bytes.fromhex(h) for h in current]
        sides = []
        for i in range(len(raw)):
            low = i - i % FAN
            sides.append((b"".join(raw[low:i]), b"".join(raw[i + 1 : low + FAN])))
        levels.append(sides)
        current = [hashlib.sha256("".join(current[i : i + FAN]).encode()).hexdigest() for i in range(0, len(current), FAN)]
    return levels, current[0]


def _height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


NODE = (
    "tree string, idx long, n long, hash binary, carried struct<doc_id:{id},tampered:binary>, "
    "path array<struct<left:binary,right:binary>>, block long, top binary"
)


def build_blocks(nodes: DataFrame, id_type: str, stride: int) -> DataFrame:
    """``nodes`` (tree, idx, n, hash, carried) with ``path``, the siblings up to the block's top, and ``top``."""
    size = FAN**stride
    blocks = nodes.groupBy("tree", "n", F.floor(F.col("idx") / size).cast("long").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "hash", "carried"))).alias("rows")  # at most 3^stride
    )
    names = ["tree", "idx", "n", "hash", "carried", "path", "block", "top"]
    side = pa.struct([("left", pa.binary()), ("right", pa.binary())])

    def run(batches):
        for batch in batches:
            trees, sizes, numbers = (batch.column(i).to_pylist() for i in range(3))
            rows = batch.column(3)
            flat = rows.flatten()
            at, hashes = 0, flat.field(1).to_pylist()
            lefts, rights, steps, tops, of = [], [], [0], [], []
            for b, count in enumerate(rows.value_lengths().to_pylist()):
                climbs = min(stride, _height(sizes[b]))
                levels, top = block_levels([h.hex() for h in hashes[at : at + count]], climbs)
                for i in range(count):
                    for level in levels:
                        left, right = level[i]
                        lefts.append(left)
                        rights.append(right)
                        i //= FAN
                    steps.append(steps[-1] + climbs)
                tops += [bytes.fromhex(top)] * count
                of += [b] * count
                at += count
            sides = pa.StructArray.from_arrays([pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], fields=list(side))
            path = pa.ListArray.from_arrays(pa.array(steps, pa.int32()), sides)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([trees[b] for b in of]), flat.field(0), pa.array([sizes[b] for b in of], pa.int64()), flat.field(1),
                    flat.field(2), path, pa.array([numbers[b] for b in of], pa.int64()), pa.array(tops, pa.binary()),
                ],
                names,
            )

    return blocks.select("tree", "n", "block", "rows").mapInArrow(run, NODE.format(id=id_type))


def _tree_levels(nodes: DataFrame, id_type: str, stride: int, name: str) -> list[DataFrame]:
    """Stored passes over trees, lowest first; a pass goes on with the tops of those trees that have several blocks."""
    size, passes = FAN**stride, []
    while True:
        made = stage(build_blocks(nodes, id_type, stride), f"merkle_{name}")
        passes.append(made)
        more = made.filter(F.col("n") > size)
        if more.isEmpty():
            return passes
        nodes = more.filter(F.col("idx") % size == 0).select(
            "tree", F.col("block").alias("idx"), F.ceil(F.col("n") / size).cast("long").alias("n"),
            F.col("top").alias("hash"), F.lit(None).cast(f"struct<doc_id:{id_type},tampered:binary>").alias("carried"),
        )


def stored_nodes(docs: DataFrame, stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """(leaves, upper): node rows of level 0, with doc_id, leaf, tampered, and of all stored levels above.

    Both have tree, level, idx, path, top, and the parent (up_tree, up_level, up_idx); no parent means the root.
    ``top`` is the hash of the tree where a row's path ends there.
    """
    id_type = docs.select(column("doc_id")).schema[0].dataType.simpleString()
    carried = F.struct("doc_id", "tampered").alias("carried")
    rows = numbered(hashed_rows(docs), "tree", ("doc_id", "leaf")).select("tree", "idx", "n", F.col("leaf").alias("hash"), carried)
    trees = _tree_levels(rows, id_type, stride, "source")
    size = F.lit(FAN**stride)
    ends = None
    for made in trees:
        part = made.filter((F.col("n") <= size) & (F.col("idx") == 0)).select("tree", F.col("top").alias("hash"))
        ends = part if ends is None else ends.unionByName(part)
    ranked = stage(numbered(ends.withColumn("_all", F.lit(ROOT)), "_all", ("tree",)), "merkle_subroots")
    none = F.lit(None).cast(f"struct<doc_id:{id_type},tampered:binary>").alias("carried")
    roots = _tree_levels(ranked.select(F.col("_all").alias("tree"), "idx", "n", "hash", none), id_type, stride, "root")
    places = ranked.select(F.col("tree").alias("_tree"), F.col("idx").alias("_rank"))
    stored = []
    for in_root, passes in ((False, trees), (True, roots)):
        for level, made in enumerate(passes):
            ended = F.col("n") <= size
            if in_root:
                linked = made.withColumn("_rank", F.lit(None).cast("long"))
            else:
                # only the last rows of a tree, at most 3^stride, look up the place of their tree
                last = made.filter(ended).join(places, F.col("tree") == F.col("_tree")).drop("_tree")
                linked = last.unionByName(made.filter(~ended).withColumn("_rank", F.lit(None).cast("long")))
            up = F.when(~ended, F.col("tree")) if in_root else F.when(ended, F.lit(ROOT)).otherwise(F.col("tree"))
            stored.append(
                linked.select(
                    "tree", F.lit(level).alias("level"), "idx", "hash", "carried", "path",
                    F.when(ended, F.col("top")).alias("top"),
                    up.alias("up_tree"),
                    F.when(ended, F.lit(0)).otherwise(F.lit(level + 1)).alias("up_level"),
                    F.when(ended, F.col("_rank")).otherwise(F.col("block")).alias("up_idx"),
                )
            )
    leaves = stored[0].select(
        F.col("carried.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), F.col("carried.tampered").alias("tampered"),
        "path", "top", "up_tree", "up_level", "up_idx",
    )
    upper = None
    for made in stored[1:]:
        made = made.select("tree", "level", "idx", "path", "top", "up_tree", "up_level", "up_idx")
        upper = made if upper is None else upper.unionByName(made)
    return leaves, stage(upper, "merkle_nodes")


# folding: hex hash and siblings to the hash of the parent, along a path; appending: the siblings themselves
FOLD = "aggregate({path}, {start}, (h, s) -> sha2(cast(concat(lower(hex(s.left)), h, lower(hex(s.right))) as binary), 256))"
APPEND = "aggregate({path}, {start}, (p, s) -> concat(p, s.left, s.right))"

CLIMB = f"""
WITH RECURSIVE climb(doc_id, leaf, tree, level, idx, folded, proof, subroot, root) MAX RECURSION LEVEL 1000 AS (
  SELECT doc_id, leaf, up_tree, up_level, up_idx, {FOLD.format(path="path", start="lower(hex(tampered))")},
    {APPEND.format(path="path", start="cast('' as binary)")}, top, cast(NULL as binary)
  FROM {{leaves}}
  UNION ALL
  SELECT c.doc_id, c.leaf, n.up_tree, n.up_level, n.up_idx, {FOLD.format(path="n.path", start="c.folded")},
    {APPEND.format(path="n.path", start="c.proof")}, coalesce(c.subroot, n.top),
    CASE WHEN c.tree = '{ROOT}' THEN n.top END
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.level = n.level AND c.idx = n.idx)
SELECT doc_id, leaf, subroot, root, proof, folded FROM climb WHERE tree IS NULL"""


def proofs(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded): one row per row of ``docs``, hashes in binary but ``folded``.

    Leaves ascend by (source, doc_id), nulls first; rows equal in both ascend by leaf hash, and equal rows are leaves of
    their own. Null fields are ``-``, which no value is. Extra columns are ignored; an empty table gives no rows.
    ``proof``: the siblings' digests, level by level up to the root, left to right.
    """
    spark = docs.sparkSession
    small_batches(spark)
    leaves, nodes = stored_nodes(docs, stride)
    names = {name: f"merkle_{name}_{uuid.uuid4().hex[:12]}" for name in ("leaves", "nodes")}
    leaves.createOrReplaceTempView(names["leaves"])
    nodes.createOrReplaceTempView(names["nodes"])
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")  # a row for each leaf
    try:
        return stage(spark.sql(CLIMB.format(**names)), "merkle_proofs")
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)
        for name in names.values():
            spark.catalog.dropTempView(name)


def manifest(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), hashes in lowercase hex; cases as in ``proofs``."""
    rows = proofs(docs, stride)

    def shown(name: str) -> Column:
        return F.lower(F.hex(name))

    return rows.select(
        "doc_id", shown("leaf").alias("leaf"), shown("subroot").alias("subroot"), shown("root").alias("root"),
        digest(shown("proof")).alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == shown("root")).alias("verified"),
    )


def _sql_field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(CAST({name} AS VARCHAR)) || ':' || {name} END"


# bit by bit: the parity of crc32 is all that counts, so the final inversion only flips it
MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
    {" || ".join(_sql_field(c) for c in FIELDS[:4])} AS head, text,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: list_concat([CAST(256 + ascii(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b - 256) WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) & 1 AS odd
  FROM documents),
h AS (SELECT doc_id, tree, sha256(head || {_sql_field("text")}) AS leaf,
    sha256(head || {_sql_field("CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END")}) AS tampered FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY tree) AS n FROM h),
l(tree, level, idx, hash, n) AS (
  SELECT tree, 0, idx, leaf, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)), (n + 2) // 3 FROM l
  WHERE n > 1 GROUP BY tree, level, idx // 3, n),
s AS (SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM l WHERE n = 1),
r(level, idx, hash, n) AS (
  SELECT 0, idx, hash, n FROM s
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)), (n + 2) // 3 FROM r WHERE n > 1 GROUP BY level, idx // 3, n),
nodes AS (
  SELECT tree, level, idx, hash, n FROM l UNION ALL SELECT '/', level, idx, hash, n FROM r),
sides AS (
  SELECT tree, level, idx, n,
    coalesce(string_agg(hash, '' ORDER BY o) FILTER (o < idx), '') AS lefts,
    coalesce(string_agg(hash, '' ORDER BY o) FILTER (o > idx) , '') AS rights
  FROM (SELECT a.tree, a.level, a.idx, a.n, b.idx AS o, b.hash FROM nodes a JOIN nodes b
    ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1) GROUP BY tree, level, idx, n),
c(doc_id, leaf, own, tree, level, idx, n, folded, proof) AS (
  SELECT doc_id, leaf, tree, tree, 0, idx, n, tampered, '' FROM leaves
  UNION ALL
  SELECT doc_id, leaf, own, CASE WHEN c.n = 1 THEN '/' ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.n = 1 THEN s.idx ELSE c.idx // 3 END, CASE WHEN c.n = 1 THEN s.n ELSE (c.n + 2) // 3 END,
    CASE WHEN c.n = 1 THEN folded ELSE sha256(lefts || folded || rights) END,
    CASE WHEN c.n = 1 THEN proof ELSE proof || lefts || rights END
  FROM c LEFT JOIN sides ON c.tree = sides.tree AND c.level = sides.level AND c.idx = sides.idx
    LEFT JOIN s ON c.tree = s.tree
  WHERE c.n > 1 OR c.tree <> '/')
SELECT c.doc_id, c.leaf, s.hash AS subroot, t.hash AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root,
  c.folded = t.hash AS verified
FROM c JOIN s ON c.own = s.tree, (SELECT hash FROM r WHERE n = 1) t WHERE c.tree = '/' AND c.n = 1"""


@query("op12_merkle", MERKLE_SQL)
def op12_merkle(spark, sf_dir):
    return manifest(documents(spark, sf_dir))
