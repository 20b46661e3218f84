"""Connected components by contraction, as DataFrame joins on staged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import hot_lookup
from tidemark.sources.staging import stage, unstage


def _ranked(node: str, turn: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("rank"), F.col(node).alias("node"))


def components(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns ``u``, ``v``); root is the component's smallest node.

    Each round ranks the nodes anew by a hash, points every node at its neighbour of least rank (or itself), follows
    the pointers twice and contracts the edges. As ranks are random, paths of falling rank are short whatever the
    order of ids: a chain shrinks about threefold, so rounds grow with the logarithm of the longest path. Rounds are
    written to the shared folder, so lineage stays short; tables of earlier rounds are deleted. ``rounds`` gets the
    number of edges left after each round.
    """
    links = stage(
        edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        "links",
    )
    steps, turn = [], 0  # per round: where each of its nodes moved
    while not links.isEmpty():
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(_ranked("v", turn)).alias("m"))
        pointers = [stage(least.select("u", F.least(_ranked("u", turn), "m")["node"].alias("p")), "parents")]
        for _ in range(2):
            up = pointers[-1].select(F.col("u").alias("p"), F.col("p").alias("pp"))
            pointers.append(stage(pointers[-1].join(up, "p").select("u", F.col("pp").alias("p")), "parents"))
        parent = pointers.pop()
        unstage(*pointers)
        steps.append(parent)
        left = parent.select("u", F.col("p").alias("a"))
        right = parent.select(F.col("u").alias("v"), F.col("p").alias("b"))
        moved = links.join(left, "u").join(right, "v").filter("a <> b")
        moved = stage(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
        unstage(links)
        links, turn = moved, turn + 1
        if rounds is not None:
            rounds.append(links.count())
    if not steps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # the last, smallest rounds are followed first: a node is moved once per round that it took part in
    ends = steps.pop()
    while steps:
        earlier, later = steps.pop(), ends
        last = later.select(F.col("u").alias("p"), F.col("p").alias("end"))
        ends = stage(earlier.join(last, "p", "left").select("u", F.coalesce("end", "p").alias("p")), "parents")
        unstage(earlier, later)
    nodes = ends.select(F.col("u").alias("node"), F.col("p").alias("root"))
    names = nodes.groupBy("root").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("members"))
    named = hot_lookup(nodes, stage(names, "roots"), "root", "members", nodes.count())
    return named.select("node", F.col("least").alias("root"))
