"""Merges of new rows into a snapshot with a policy for every column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: overwrite: the new value wins; coalesce: unless it is null; fill: only where the old one is null; union: arrays are joined as sets.
POLICIES = ("overwrite", "coalesce", "fill", "union")


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], policy: Mapping[str, str], insert: bool = True) -> DataFrame:
    """The next snapshot: rows of either side, columns by their policy. Both sides must be unique on ``keys``."""
    o = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in policy], F.lit(True).alias("_old"))
    n = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in policy], F.lit(True).alias("_new"))
    joined = o.join(n, list(keys), "full_outer" if insert else "left")

    def chosen(c: str, how: str):
        a, b = F.col(f"o_{c}"), F.col(f"n_{c}")
        if how == "overwrite":
            return F.when(F.col("_new"), b).otherwise(a)
        if how == "coalesce":
            return F.coalesce(b, a)
        if how == "fill":
            return F.coalesce(a, b)
        if how == "union":
            return F.array_sort(F.array_union(F.coalesce(a, b), F.coalesce(b, a)))
        raise ValueError(f"unknown policy {how!r}, not one of {POLICIES}")

    return joined.select(*keys, *[chosen(c, how).alias(c) for c, how in policy.items()])


def changed_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of ``new`` that differ, null-safely, from those of ``old``, or that it has not."""
    o = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in columns], F.lit(True).alias("_old"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    return new.join(o, list(keys), "left").where(F.col("_old").isNull() | ~same).select(*new.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there yet."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Children of parents that ``new`` has any for are replaced; an empty list wipes nothing."""
    return old.join(new.select(*parent).distinct(), list(parent), "left_anti").unionByName(new)
