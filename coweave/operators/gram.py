"""Gram matrix of interactions: P = X^T X in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .copairs import MAX_GROUP, pair_products


def upper_half(x: DataFrame, integral: bool = True, max_group: int = MAX_GROUP) -> DataFrame:
    """(item, neighbor, p) of the Gram matrix where item <= neighbor; zeros are not stored.

    ``x`` is canonical (user, item, value) with bigint ids. Users of more than ``max_group`` items take the tiled way of
    `pair_products`, so no task emits all pairs of a large user.
    """
    pairs = pair_products(x, "user", "item", "value", diagonal=True, integral=integral, max_group=max_group)
    return pairs.where(F.col("s") != 0).select(F.col("a").alias("item"), F.col("b").alias("neighbor"), F.col("s").alias("p"))


def mirrored(half: DataFrame) -> DataFrame:
    """The whole matrix of its upper half."""
    there, back = F.struct("item", "neighbor"), F.struct(F.col("neighbor").alias("item"), F.col("item").alias("neighbor"))
    both = F.when(F.col("item") == F.col("neighbor"), F.array(there)).otherwise(F.array(there, back))
    return half.select(F.explode(both).alias("at"), "p").select("at.item", "at.neighbor", "p")


def gram(x: DataFrame, integral: bool = True, max_group: int = MAX_GROUP) -> DataFrame:
    """(item, neighbor, p) with the diagonal as rows where both are equal. Symmetric; zeros are not stored. See `upper_half`."""
    return mirrored(upper_half(x, integral, max_group))


def diagonal(p: DataFrame) -> DataFrame:
    """(item, p) of the diagonal."""
    return p.where(F.col("item") == F.col("neighbor")).select("item", "p")


def off_diagonal(p: DataFrame) -> DataFrame:
    return p.where(F.col("item") != F.col("neighbor"))


def candidates(p: DataFrame, lambd: float) -> DataFrame:
    """Stored off-diagonal entries with p >= lambd: the only weights of `item` that can be positive."""
    return off_diagonal(p).where((F.col("p") != 0) & (F.col("p") >= F.lit(float(lambd))))


def gram_row(p: DataFrame, item: int) -> DataFrame:
    """Off-diagonal entries of one item, neighbours ascending."""
    return off_diagonal(p).where(F.col("item") == item).select("neighbor", "p").orderBy("neighbor")


def refuse_overflow(diagonal: float | None) -> None:
    """Raises if the largest diagonal entry is infinite; by Cauchy-Schwarz no entry of the Gram matrix is larger."""
    if diagonal == float("inf"):
        raise ValueError("interaction values are too large: the Gram matrix overflowed to infinity")
