"""Array-valued feature vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def squared_distance(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)


def l2_normalise(a: Column) -> Column:
    """Unit length; a zero vector becomes NULLs."""
    return F.transform(a, lambda x: x / F.nullif(F.sqrt(dot(a, a)), F.lit(0.0)))


def window_width(d: int) -> int:
    """Fixed rule: 2 up to 40 features, 10 up to 160, d - 150 above."""
    return 2 if d <= 40 else 10 if d <= 160 else d - 150


def array_complement(a: Column, positions: Column) -> Column:
    """Elements of ``a`` whose 0-based position is not listed, order kept."""
    return F.filter(a, lambda x, i: ~F.array_contains(positions, i))


def feature_windows(a: Column, k: int, d: int) -> Column:
    """Every contiguous window of ``k`` features with the features outside it."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(d - k + 1)),
        lambda j: F.struct(
            (j - 1).alias("start"),
            F.slice(a, j, k).alias("inside"),
            F.concat(F.slice(a, F.lit(1), j - 1), F.slice(a, j + k, F.lit(d))).alias("outside"),
        ),
    )


def contrastive_loss(queries: Column, keys: Column, temperature: float = 0.01) -> Column:
    """Mean over i of -log softmax of (query i, key i) against the other keys.

    ``queries`` and ``keys`` are arrays of equally long vectors. The positive pair
    counts once: it is the first logit and is masked among the negatives.
    """

    def one(query, i):
        logits = F.transform(keys, lambda key: dot(query, key) / F.lit(temperature))
        top = F.array_max(logits)
        total = F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top))
        return F.log(total) + top - F.get(logits, i)

    losses = F.transform(queries, one)
    return F.aggregate(losses, F.lit(0.0), lambda s, v: s + v) / F.size(queries)
