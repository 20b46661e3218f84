"""Column roles, split protocol and explicit schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns are categorical, numeric, carried along, or the label.

    The roles are plain column names; ``renamed`` gives the role-prefixed names
    (``cat_*``, ``num_*``, ``bonus_*``, ``label``) used after ``rename_roles``.
    """

    cat: tuple[str, ...] = ("0", "1", "2", "3", "13")
    num: tuple[str, ...] = ("4", "5", "6", "7", "8", "9", "10", "11", "12")
    bonus: tuple[str, ...] = ("14", "15", "16", "17", "19")
    label: str = "18"

    @property
    def sentence(self) -> tuple[str, ...]:
        """Feature columns in positional order, as read by the token model."""
        return tuple(sorted(self.cat + self.num, key=lambda c: (len(c), c)))

    @property
    def renamed(self) -> dict[str, str]:
        names = {c: f"cat_{c}" for c in self.cat}
        names |= {c: f"num_{c}" for c in self.num}
        names |= {c: f"bonus_{c}" for c in self.bonus}
        return names | {self.label: "label"}


FLOW_TABLE = FeatureSpec()

RAW_COLUMNS = tuple(str(i) for i in range(20))
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


@dataclass(frozen=True)
class SplitProtocol:
    """Years of the out-of-distribution protocol.

    Training years feed TRAIN (part ``train``) and IID (part ``valid``); later
    years up to ``near_last`` are NEAR and the rest are FAR, whole.
    """

    train_first: int = 2006
    train_last: int = 2010
    near_last: int = 2013

    def trained(self, year: Column, part: Column) -> Column:
        """Is the row in the training split?"""
        return year.between(self.train_first, self.train_last) & (part == "train")

    def column(self, year: Column, part: Column) -> Column:
        trained = year.between(self.train_first, self.train_last)
        return (
            F.when(trained & (part == "valid"), F.lit("IID"))
            .when(trained, F.lit("TRAIN"))
            .when(year.between(self.train_last + 1, self.near_last), F.lit("NEAR"))
            .when(year > self.near_last, F.lit("FAR"))
        )


def in_distribution_split(
    year: Column, part: Column, years: tuple[int, ...], first_five: bool = False
) -> Column:
    """The in-distribution protocol: train and held-out part of the same years."""
    used = sorted(years)[:5] if first_five else sorted(years)
    return F.when(
        year.isin(*used), F.when(part == "valid", F.lit("ID")).otherwise(F.lit("TRAIN"))
    )
