"""Logarithmic binning with right-closed intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Edge i is 1.1^i - 1, 233 edges; the outer two are widened by 0.01.
BASE = 1.1
N_EDGES = 233
WIDEN = 0.01
OUT_OF_RANGE = "nan"


def log_edges() -> list[float]:
    edges = [BASE**i - 1 for i in range(N_EDGES)]
    edges[0] -= WIDEN
    edges[-1] += WIDEN
    return edges


def log_bin_index(x: Column) -> Column:
    """0-based bin of ``(edge[i], edge[i+1]]``; NULL outside the edges.

    The index is estimated with a logarithm and moved by one where the literal
    edges disagree, so no per-row search over 233 edges is needed.
    """
    edges = log_edges()
    table = F.expr("array(" + ",".join(f"{e!r}D" for e in edges) + ")")
    guess = (F.ceil(F.log1p(x) / F.lit(math.log(BASE))) - 1).cast("int")
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(N_EDGES - 2))
    moved = guess + (x > F.get(table, guess + 1)).cast("int") - (x <= F.get(table, guess)).cast("int")
    inside = (x > F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    small = x <= F.lit(edges[1])  # also keeps log1p away from x near -1
    return F.when(inside, F.when(small, F.lit(0)).otherwise(moved))


def log_bin(x: Column, column: str, overflow: str = OUT_OF_RANGE) -> Column:
    """Text label ``c<column><bin>``; values outside the edges (and NULL) become ``overflow``."""
    return F.coalesce(F.concat(F.lit(f"c{column}"), log_bin_index(x).cast("string")), F.lit(overflow))
