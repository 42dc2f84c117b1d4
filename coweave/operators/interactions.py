"""Interactions: the long form (user, item, value) of a user x item matrix, checked and canonical."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.shared import written
from ..functions.sums import exact_sum, limbs, ordered_sum

SCHEMA = ("user", "item", "value")


def is_finite(c: Column) -> Column:
    return ~(F.isnan(c) | c.isin(float("inf"), float("-inf")))


def as_interactions(df: DataFrame, user: str = "user", item: str = "item", value: str | None = "value") -> DataFrame:
    """Renames to (user, item, value: double); ``value=None`` stands for 1.0 in every row. Other columns are left out."""
    missing = [c for c in (user, item, *([value] if value else [])) if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not found; the frame has {df.columns}")
    amount = F.col(value).cast("double") if value else F.lit(1.0)
    return df.select(F.col(user).alias("user"), F.col(item).alias("item"), amount.alias("value"))


@dataclass(frozen=True)
class Facts:
    """What is known of checked values: ``rows``; whether all are whole numbers so small that sums of products stay exact
    (``integral``); the largest and the least magnitude above zero."""

    rows: int
    integral: bool
    largest: float = 0.0
    least: float = 0.0


def _judged(found: Row, name: str, signed: bool) -> Facts:
    if found.nulls:
        raise ValueError(f"{name} must not hold null ids or values, but {found.nulls} do")
    for cell, rule in ((found.broken, "contain only finite values"), (None if signed else found.negative, "be non-negative")):
        if cell is not None:
            raise ValueError(f"{name} must {rule}, but user {cell.user} has {cell.value} for item {cell.item}")
    return Facts(found.rows, bool(found.whole) and found.squares < 2.0**53, found.largest or 0.0, found.least or 0.0)


def check_values(df: DataFrame, name: str = "interactions", signed: bool = False) -> Facts:
    """One pass over (user, item, value); raises ValueError naming an offending cell.

    Null ids or values come first, then non-finite values, then (unless ``signed``) negative ones.
    """
    v = F.col("value")
    null = F.col("user").isNull() | F.col("item").isNull() | v.isNull()
    broken, negative = ~null & ~is_finite(v), ~null & (v < 0)
    cell = F.struct("user", "item", "value")
    size = F.when(~null & ~broken & (v != 0), F.abs(v))
    found = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(null).alias("nulls"),
        F.min(F.when(broken, cell)).alias("broken"),
        F.min(F.when(negative, cell)).alias("negative"),
        F.coalesce(F.bool_and(v == F.floor(v)), F.lit(True)).alias("whole"),
        F.coalesce(F.sum(size * size), F.lit(0.0)).alias("squares"),
        F.max(size).alias("largest"),
        F.min(size).alias("least"),
    )
    return _judged(found.first(), name, signed)


def canonical(df: DataFrame, name: str = "interactions", integral: bool | None = None) -> DataFrame:
    """Unique (user, item) cells: repeated rows are summed, cells that sum to zero dropped. Lazy but for the check.

    Values are checked before they are summed (-1 and 2 in one cell are still an error), which runs one job; pass ``integral=True``
    for values known to be whole numbers. Sums do not depend on partitioning.
    """
    facts = Facts(0, True) if integral else check_values(df, name)
    if facts.integral:  # whole numbers add up exactly in any order
        summed = df.groupBy("user", "item").agg(F.sum("value").alias("value"))
    else:
        summed = _fractions(df, facts)
    return summed.where(F.col("value") != 0)


def _fractions(df: DataFrame, facts: Facts) -> DataFrame:
    layout = limbs(facts.largest, facts.least, facts.rows)
    if layout is not None:
        return exact_sum(df, ["user", "item"], F.col("value"), layout, "value")
    return ordered_sum(df, ["user", "item"], F.col("value"), F.col("value"), "value")


def settled(df: DataFrame, name: str = "interactions", signed: bool = False) -> tuple[DataFrame, Facts]:
    """`check_values` and `canonical` in one pass over ``df``: the written cells and their facts.

    Cells carry what the check needs to the written table, which is then looked at once. Only values that are no
    whole numbers, in cells of several rows, need a second pass over ``df``.
    """
    v = F.col("value")
    cells = df.groupBy("user", "item").agg(
        F.sum("value").alias("value"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(v.isNull()).alias("_nulls"),
        F.min("value").alias("_low"),
        F.max("value").alias("_high"),
        F.coalesce(F.bool_and(v == F.floor(v)), F.lit(True)).alias("_whole"),
    )
    cells = written(cells, "cells")
    low, high = F.col("_low"), F.col("_high")
    null = F.col("user").isNull() | F.col("item").isNull()
    broken, negative = ~null & ~(is_finite(low) & is_finite(high)), ~null & (low < 0)
    cell = lambda worst: F.struct("user", "item", worst.alias("value"))
    span = F.greatest(F.abs(low), F.abs(high))
    reach = span * F.col("_n")  # no sum of a part of the cell is beyond this
    small = F.least(F.when(low != 0, F.abs(low)), F.when(high != 0, F.abs(high)), F.when(v != 0, F.abs(v)))
    found = cells.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(null, F.col("_n")).otherwise(F.col("_nulls"))), F.lit(0)).alias("nulls"),
        F.min(F.when(broken, cell(F.when(is_finite(low), high).otherwise(low)))).alias("broken"),
        F.min(F.when(negative, cell(low))).alias("negative"),
        F.coalesce(F.bool_and("_whole"), F.lit(True)).alias("whole"),
        F.coalesce(F.sum(reach * reach), F.lit(0.0)).alias("squares"),
        F.max(F.when(reach > 0, reach)).alias("largest"),
        F.min(small).alias("least"),
        F.max("_n").alias("most"),
    ).first()
    facts = _judged(found, name, signed)
    if not facts.integral and found.most > 1:
        cells = written(_fractions(df, check_values(df, name, signed)), "cells")
    return cells.where(F.col("value") != 0).select("user", "item", "value"), facts


def binarise(df: DataFrame) -> DataFrame:
    """Value 1.0 where it was positive; other rows are left out."""
    return df.where(F.col("value") > 0).withColumn("value", F.lit(1.0))


def transpose(df: DataFrame) -> DataFrame:
    """Rows regrouped by item, users ascending in each: the column-compressed view, partitioned by item. A grouping by item that follows uses this partitioning."""
    return df.repartition("item").sortWithinPartitions("item", "user")


def item_universe(x: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Distinct items: those given and, without ``items``, those that occur."""
    return (items if items is not None else x).select("item").where(F.col("item").isNotNull()).distinct()


def user_universe(x: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Distinct users: those given and, without ``users``, those that occur."""
    return (users if users is not None else x).select("user").where(F.col("user").isNotNull()).distinct()


def holdout_split(x: DataFrame, train_tenths: int = 8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by arithmetic on numeric keys, so a cell falls on the same side at every run and in every engine."""
    tenth = F.pmod(F.col("user") * 31 + F.col("item") * 17 + seed, F.lit(10))
    return x.where(tenth < train_tenths), x.where(tenth >= train_tenths)


def random_split(x: DataFrame, fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): each cell falls on the train side with chance ``fraction``, by a seeded hash of its keys, so a re-run task splits alike."""
    side = F.pmod(F.xxhash64("user", "item", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)
    return x.where(side), x.where(~side)
