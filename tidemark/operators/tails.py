"""Empirical tail probabilities and the two detectors built on them (ECOD, COPOD).

The fit ranks the distinct train values of each feature once and stores them in slices of bounded size. A test
value is looked up as of its place: the heads of the slices say in which slice it falls, the slice
says how many train rows lie at or below it. Fitted values are never ranked again, whatever the test table,
and scores never depend on how test rows are batched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.encoding import long_form
from tidemark.operators.ordering import join_same, running_totals
from tidemark.sources.staging import stage, unstage


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, w): rows per distinct value, NULLs left out."""
    cells = long_form(df, [], columns).filter("value IS NOT NULL")
    return cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("w"))


SLICE = 64  # distinct values of a slice
MANY_VALUES = 1_000_000


class EcdfTable:
    """Fitted values of each feature: ``slices`` (feature, slice, head, values, le, before, n), both arrays of at most SLICE entries.

    Slices count from 1; ``le`` is the number of train rows at or below a value, ``before`` of those below the slice,
    ``n`` of all rows of the feature.
    """

    def __init__(self, counts: DataFrame):
        ranked = running_totals(counts.withColumn("one", F.lit(1).cast("long")), ["feature"], "value", ["w", "one"])
        entry = F.struct("value", F.col("cum_w").alias("le"))
        cut = ranked.groupBy("feature", (F.floor((F.col("cum_one") - 1) / SLICE) + 1).cast("long").alias("slice"))
        cut = cut.agg(
            F.array_sort(F.collect_list(entry)).alias("v"), F.min(F.col("cum_w") - F.col("w")).alias("before"), F.max("all_w").alias("n")
        )
        slices = cut.select(
            "feature", "slice", F.col("v")[0]["value"].alias("head"), F.transform("v", lambda e: e["value"]).alias("values"),
            F.transform("v", lambda e: e["le"]).alias("le"), "before", "n",
        )
        self.slices = stage(slices, "ecdf_slices")

    @classmethod
    def of(cls, slices: DataFrame) -> EcdfTable:
        """A table fitted before, from its slices."""
        table = cls.__new__(cls)
        table.slices = slices
        return table

    def at(self, test: DataFrame, columns: Sequence[str]) -> DataFrame:
        """(feature, value, le, ge, n) for the distinct values of ``test``, NULLs left out.

        Ordered are only these values and one head in SLICE fitted values: the running number of heads is the slice.
        """
        seen = long_form(test, [], columns).filter("value IS NOT NULL").distinct()
        return self.at_values(seen)

    def at_values(self, seen: DataFrame) -> DataFrame:
        """As ``at``, for distinct (feature, value) rows."""
        heads = self.slices.select("feature", F.col("head").alias("value"), F.lit(1).alias("h"), F.lit(False).alias("asked"))
        asked = seen.select("feature", F.col("value").cast("double").alias("value"), F.lit(0).alias("h"), F.lit(True).alias("asked"))
        both = heads.unionByName(asked).groupBy("feature", "value").agg(F.sum("h").alias("h"), F.max("asked").alias("asked"))
        placed = running_totals(both, ["feature"], "value", ["h"]).filter("asked")
        placed = placed.select("feature", "value", F.greatest("cum_h", F.lit(1)).alias("slice"))
        met = join_same(placed, self.slices, ["feature", "slice"])  # at most SLICE numbers per row
        v = F.col("value")
        upto = F.size(F.filter("values", lambda x: x <= v))
        below = upto - F.array_contains("values", v).cast("int")

        def rows_to(count: Column) -> Column:
            return F.when(count > 0, F.get("le", count - 1)).otherwise(F.col("before"))

        return met.select("feature", "value", rows_to(upto).alias("le"), (F.col("n") - rows_to(below)).alias("ge"), "n")


def ecdf_at(counts: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, le, ge, n) for the distinct values of ``test``, looked up in fitted ``counts``."""
    return EcdfTable(counts).at(test, columns)


def ecdf(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, le, ge, n) for the distinct values of train and test: one ordered pass, as nothing is fitted before."""
    seen = long_form(test, [], columns).filter("value IS NOT NULL").distinct().withColumn("w", F.lit(0).cast("long"))
    merged = value_counts(train, columns).unionByName(seen).groupBy("feature", "value").agg(F.sum("w").alias("w"))
    ranked = running_totals(merged, ["feature"], "value", ["w"])
    ge = F.col("all_w") - F.col("cum_w") + F.col("w")
    return ranked.select("feature", "value", F.col("cum_w").alias("le"), ge.alias("ge"), F.col("all_w").alias("n"))


def tail(count: Column, n: Column) -> Column:
    """-ln of a tail probability, floored at 1/(n+1) so unseen tails stay finite."""
    return -F.log(F.greatest(count / n, F.lit(1.0) / (n + 1)))


def _merge_tails(left: Column, right: Column, skew: Column, rule: str) -> Column:
    chosen = F.when(skew < 0, left).when(skew > 0, right).otherwise(left + right)
    if rule == "ecod":
        return F.greatest(left, right, chosen)
    return F.greatest((left + right) / 2, chosen)


class TailModel:
    """Fitted tables of ECOD and COPOD: value counts, skews, category counts. Both rules score from one fit."""

    def __init__(self, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()):
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.ecdf = EcdfTable(stage(value_counts(train, self.numeric), "value_counts"))
        skews = train.agg(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.skewness(c).alias("skew")) for c in self.numeric]).alias("s")
        ).select(F.inline("s"))
        skews = skews.select("feature", F.when(F.isnan("skew"), F.lit(0.0)).otherwise(F.col("skew")).alias("skew"))
        self.skews = stage(skews, "skews")
        if self.categorical:
            cells = long_form(train, [], self.categorical, value="category").filter("category IS NOT NULL")
            counts = cells.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("k"))
            total = train.agg(F.count(F.lit(1)).alias("n")).scalar()
            self.categories = stage(counts.withColumn("n", total), "category_counts")

    def tables(self) -> dict[str, DataFrame]:
        """The fitted tables by name."""
        found = {"slices": self.ecdf.slices, "skews": self.skews}
        return {**found, "categories": self.categories} if self.categorical else found

    @classmethod
    def of(cls, tables: dict[str, DataFrame], numeric: Sequence[str], categorical: Sequence[str] = ()) -> TailModel:
        """A model fitted before, from its ``tables``."""
        model = cls.__new__(cls)
        model.numeric, model.categorical = list(numeric), list(categorical)
        model.ecdf, model.skews, model.categories = EcdfTable.of(tables["slices"]), tables["skews"], tables.get("categories")
        return model

    def _numeric_tails(self, test: DataFrame, rule: str) -> DataFrame:
        """(feature, value, out)"""
        table = self.ecdf.at(test, self.numeric).join(self.skews, "feature")
        left, right = tail(F.col("le"), F.col("n")), tail(F.col("ge"), F.col("n"))
        return table.select("feature", F.col("value"), _merge_tails(left, right, F.col("skew"), rule).alias("out"))

    def _category_tails(self, rule: str) -> DataFrame:
        """(feature, category, present, absent): tail score of each 0/1 indicator of a category.

        An indicator is 1 with probability p, so its left tail at 0 is 1-p and its right tail
        at 1 is p; the other two tails are certain. Its skew has the sign of 1-2p.
        """
        k, n, zero = F.col("k"), F.col("n"), F.lit(0.0)
        skew = n - 2 * k
        return self.categories.select(
            "feature",
            "category",
            _merge_tails(zero, tail(k, n), skew, rule).alias("present"),
            _merge_tails(tail(n - k, n), zero, skew, rule).alias("absent"),
        )

    def _numeric_lookups(self, test: DataFrame, rule: str) -> list[DataFrame]:
        """(value, out) of each numeric feature, staged one by one, so that Spark knows the size of each."""
        tails, found = stage(self._numeric_tails(test, rule), "tails"), []
        for c in self.numeric:
            own = stage(tails.filter(F.col("feature") == c).select("value", "out"), "feature_tails")
            # beyond a broadcast: rows pass by the values of their partition and are not sorted
            found.append(own.hint("shuffle_hash") if own.count() > MANY_VALUES else own)
        unstage(tails)
        return found

    def score(self, test: DataFrame, rule: str, row_id: Sequence[str] = ("copy_id",)) -> DataFrame:
        """Add ``score``: summed outlyingness over numeric features and all indicators.

        Tails are looked up in the row, feature by feature: a feature with few distinct values moves no row, one with many moves
        each row once. A row adds, for each categorical column, the total of its ``absent`` scores, corrected for the one
        category it has. Rows with the same id share the sum of their numbers; only these rows are grouped.
        Null numbers give a null score.
        """
        row_id = list(row_id)
        looked = test
        for i, own in enumerate(self._numeric_lookups(test, rule)):
            own = own.select(F.col("value").alias(f"_v{i}"), F.col("out").alias(f"_n{i}"))
            looked = looked.join(own, F.col(self.numeric[i]).cast("double") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
        numbers = sum((F.coalesce(f"_n{i}", F.lit(0.0)) for i in range(len(self.numeric))), F.lit(0.0))
        missing = sum((F.col(c).isNull().cast("long") for c in self.numeric), F.lit(0).cast("long"))
        looked = looked.withColumns({"_numbers": numbers, "_missing": missing}).drop(*[f"_n{i}" for i in range(len(self.numeric))])
        scored, total = _shared(looked, test, row_id), F.col("_numbers")
        if self.categorical:
            cats = self._category_tails(rule).select("feature", "category", (F.col("present") - F.col("absent")).alias("own"), "absent")
            total = total + F.coalesce(cats.agg(F.sum("absent").alias("base")).scalar(), F.lit(0.0))
            cats = stage(cats.select("feature", "category", "own"), "category_tails")
            for i, c in enumerate(self.categorical):
                of = cats.filter(F.col("feature") == c).select(F.col("category").alias(f"_c{i}"), F.col("own").alias(f"_o{i}"))
                scored = scored.join(of, F.col(c).cast("string") == F.col(f"_c{i}"), "left").drop(f"_c{i}")
                total = total + F.coalesce(F.col(f"_o{i}"), F.lit(0.0))
        score = F.when(F.col("_missing") == 0, total)
        return scored.withColumn("score", score).select(*test.columns, "score")


def _shared(looked: DataFrame, test: DataFrame, row_id: list[str]) -> DataFrame:
    """``_numbers`` and ``_missing`` added up over rows with the same id.

    Counted are 8-byte hashes of the ids; rows whose hash is met once stay as they are, the others are added up by the id itself.
    """
    code = F.xxhash64(*row_id)
    repeated = stage(test.groupBy(code.alias("_code")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_code"), "repeated_ids")
    if repeated.isEmpty():
        return looked
    looked = looked.withColumn("_code", code)
    alone = join_same(looked, repeated, ["_code"], "left_anti").drop("_code")
    several = join_same(looked, repeated, ["_code"], "left_semi").drop("_code")
    sums = several.groupBy(*row_id).agg(F.sum("_numbers").alias("_numbers"), F.sum("_missing").alias("_missing"))
    return alone.unionByName(join_same(several.drop("_numbers", "_missing"), sums, row_id))


def ecod(train, test, numeric, categorical=(), row_id=("copy_id",)) -> DataFrame:
    return TailModel(train, numeric, categorical).score(test, "ecod", row_id)


def copod(train, test, numeric, categorical=(), row_id=("copy_id",)) -> DataFrame:
    return TailModel(train, numeric, categorical).score(test, "copod", row_id)
