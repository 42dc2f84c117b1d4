"""Sums that do not depend on how rows are partitioned, and running sums over tables of any size."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, frexp, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Parts into which a group is spread before its terms are folded in order.
FOLD_PARTS = 64


def ordered_sum(df: DataFrame, keys: list[str], term: Column, order: Column, name: str) -> DataFrame:
    """``sum(term)`` per ``keys``, bit for bit the same for any partitioning.

    Floating-point addition depends on order, so terms are folded in the order of ``order`` inside
    ``FOLD_PARTS`` hashed parts of the group, then the parts in their own order. No task ever holds more than
    one part of a group.
    """
    part = F.pmod(F.xxhash64(order), F.lit(FOLD_PARTS)).cast("int")
    fold = lambda pairs, field: F.aggregate(F.array_sort(pairs), F.lit(0.0), lambda s, e: s + e[field])
    parts = df.groupBy(*keys, part.alias("_part")).agg(
        fold(F.collect_list(F.struct(order.alias("o"), term.cast("double").alias("t"))), "t").alias("_sum")
    )
    return parts.groupBy(*keys).agg(
        fold(F.collect_list(F.struct(F.col("_part").alias("o"), F.col("_sum").alias("t"))), "t").alias(name)
    )


@dataclass(frozen=True)
class Limbs:
    """Three whole numbers that stand for a term without loss, each ``bits`` wide, the first in units of 2**-shift.

    Whole numbers add up alike in any order, so terms need no sorting and no list: each task adds up three bigints per
    group before anything is shuffled.
    """

    shift: int
    bits: int

    def of(self, term: Column) -> list[Column]:
        rest, out = term.cast("double") * F.lit(2.0**self.shift), []
        for _ in range(3):
            out.append(F.rint(rest).cast("bigint"))
            rest = (rest - F.rint(rest)) * F.lit(2.0**self.bits)
        return out

    def total(self, sums: list[Column]) -> Column:
        one, two, three = sums
        step = F.lit(2.0**-self.bits)
        return (one + (two + three * step) * step) * F.lit(2.0**-self.shift)


def limbs(largest: float, least: float, terms: int) -> Limbs | None:
    """The layout for sums of at most ``terms`` terms of magnitudes from ``least`` to ``largest``; None if three limbs cannot hold them all exactly."""
    if not largest:
        return Limbs(0, 20)
    bits = 61 - ceil(log2(max(terms, 1)))
    top = frexp(largest)[1]
    shift = bits - top
    if not least or bits < 1 or abs(shift) + bits > 900 or top - frexp(least)[1] + 53 > 3 * bits:
        return None
    return Limbs(shift, bits)


def exact_sum(df: DataFrame, keys: list[str], term: Column, layout: Limbs, name: str, *more: Column) -> DataFrame:
    """``sum(term)`` per ``keys`` without rounding before the end: the same for any partitioning. ``more`` are further aggregates."""
    parts = df.groupBy(*keys).agg(*(F.sum(c).alias(f"_l{k}") for k, c in enumerate(layout.of(term))), *more)
    return parts.withColumn(name, layout.total([F.col(f"_l{k}") for k in range(3)])).drop("_l0", "_l1", "_l2")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of ``order`` over all rows, whatever the partitioning; written.

    Rows that agree on all of ``order`` are numbered in any order among themselves; they may fill many partitions.
    """
    tie, at = "_tie", "_at"
    mixed = df.withColumn(tie, F.monotonically_increasing_id())
    rows = written(mixed.orderBy(*order, tie).drop(tie).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(at, 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sort
    base = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.col("_base") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn(name, place).drop("_part", "_base", at)


def running_offsets(counts: DataFrame, order: list[str], amount: str, name: str, buckets: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over all rows before this one in a fixed total order.

    The order is (hash bucket of the first column, ``order``), so a running sum needs no global sort and no
    single task: running sums inside each bucket, plus the running sum of at most ``buckets`` bucket totals (four to a
    shuffle partition, and at least 256). ``order`` has to identify a row.
    """
    buckets = buckets or max(256, 4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucketed = counts.withColumn("_bucket", F.pmod(F.xxhash64(F.col(order[0])), F.lit(buckets)).cast("int"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        bucketed.groupBy("_bucket")
        .agg(F.sum(amount).alias("_total"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(F.broadcast(totals), "_bucket")  # at most `buckets` rows
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_bucket", "_base", "_inside")
    )
