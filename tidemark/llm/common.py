"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HOT_KEYS = 1000  # a key with more than 1/HOT_KEYS of the rows is hot, so there are fewer hot keys than this
CHUNK = 128  # array elements of one fold


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def column(name: str) -> Column:
    """Column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that working columns cannot clash with them."""
    return F.struct(*[column(c) for c in df.columns])


def unpacked(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(name).getField(c).alias(c) for c in columns])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that in ASCII texts, and is faster than ``translate``."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch; Spark bounds its bytes (``maxBytesPerBatch``) as well."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def hot_lookup(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``table`` (one row per ``key``; ``count``: how many of ``rows`` have it).

    Hot keys - fewer than 1000, as each has over 1/1000 of ``total`` - are broadcast, so their rows
    never meet in one task; all others are shuffled. ``how`` is inner or left; ``key`` is never null.
    """
    is_hot = F.col(count) * HOT_KEYS > F.lit(total)
    hot = F.broadcast(table.filter(is_hot))
    inner = rows.join(hot, key, "inner")
    rest = rows.join(hot.select(key), key, "left_anti").join(table.filter(~is_hot), key, how)
    return inner.unionByName(rest)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it, lambdas included."""
    return F.transform(F.array(value), use)[0]


def chunks(values: Column, size: int = CHUNK) -> Column:
    """The array cut into arrays of ``size``; of an empty one, one empty array."""
    last = F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(values, c * size + 1, F.lit(size)))


def prefix_sums(values: Column) -> Column:
    """Array of sums of all elements up to and including each one, in linear work.

    Each chunk is one running fold, which appends to a short array; the chunks' totals are summed up the same way.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")

    def running(a: Column) -> Column:
        start = F.struct(zero.alias("at"), none.alias("sums"))

        def step(s: Column, x: Column) -> Column:
            at = s["at"] + x
            return F.struct(at.alias("at"), F.concat(s["sums"], F.array(at)).alias("sums"))

        return F.aggregate(a, start, step)

    def level(a: Column, depth: int) -> Column:
        if not depth:
            return running(a)["sums"]

        def moved(folded: Column) -> Column:
            def shift(ends: Column) -> Column:
                return F.flatten(
                    F.transform(folded, lambda f, i: F.transform(f["sums"], lambda x: x + F.get(ends, i) - f["at"]))
                )

            return bound(level(F.transform(folded, lambda f: f["at"]), depth - 1), shift)

        return bound(F.transform(chunks(a), running), moved)

    def sized(a: Column) -> Column:  # up to CHUNK^3 elements no fold is longer than CHUNK
        return F.when(F.size(a) <= CHUNK, running(a)["sums"]).when(F.size(a) <= CHUNK**2, level(a, 1)).otherwise(level(a, 2))

    return bound(values, sized)
