"""Joins that stay balanced and broadcasts that are checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Most rows of a frame that is broadcast. Rows here are a few numbers wide, so this is some 30 MB.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` allow it, else unchanged (a shuffled join)."""
    return F.broadcast(df) if rows <= most else df


def spread_join(large: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, spread_on: list[str], parts: int, how: str = "inner") -> DataFrame:
    """Equi-join in which the rows of hot keys on the ``large`` side are spread over ``parts`` tasks.

    ``hot`` holds the distinct hot ``keys``; it is counted, so that marking them needs no shuffle of the large side. Rows of
    ``large`` under a hot key get a part from a hash of ``spread_on``; the matching rows of ``small`` are repeated
    once per part. All other keys use part 0.
    """
    hot = written(hot.select(*keys), "hot")
    n_hot = hot.count()
    if not n_hot:
        return large.join(small, keys, how)
    hot = broadcast_if_small(hot.withColumn("_hot", F.lit(True)), n_hot)
    spread = (
        large.join(hot, keys, "left")
        .withColumn("_spread", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_on), F.lit(parts))).otherwise(F.lit(0)).cast("int"))
        .drop("_hot")
    )
    repeated = (
        small.join(hot, keys, "left")
        .withColumn("_spread", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return spread.join(repeated, [*keys, "_spread"], how).drop("_spread")
