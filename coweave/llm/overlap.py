"""Overlap sizes between many large sets, without storing what they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import spread_join
from ..functions.shared import written
from ..functions.sums import numbered
from ..operators.copairs import MAX_GROUP, pair_products


def set_codes(sets: DataFrame, column: str) -> DataFrame:
    """(column, code): ascending bigint codes of the distinct sets; bigint sets are their own code."""
    named = sets.select(column).distinct()
    if sets.schema[column].dataType == T.LongType():
        return named.withColumn("code", F.col(column))
    return written(named.orderBy(column).withColumn("code", F.monotonically_increasing_id()), "set-codes")


def overlaps(rows: DataFrame, set_column: str, id_column: str, *, max_group: int = MAX_GROUP) -> DataFrame:
    """(set_a, set_b, shared, size_a, size_b) for all pairs of sets, set_a < set_b, that share an identifier. Exact.

    Rows are deduplicated per (set, identifier); the self-join on the identifier takes set codes in ascending order, and
    its rows are counted per pair before they leave the task, so no intersection is stored or shuffled. An identifier
    in more than ``max_group`` sets is counted in tiles instead (see `pair_products`). Nulls in either column are
    left out, repeated rows count once, other columns are ignored, an empty table gives no pairs.
    """
    base = rows.select(F.col(set_column).alias("s"), F.col(id_column).alias("i")).where(F.col("s").isNotNull() & F.col("i").isNotNull())
    plain = base.schema["s"].dataType == T.LongType()
    if plain:
        coded = base.select(F.col("s").alias("code"), "i")
    else:
        codes = set_codes(base, "s")
        coded = base.join(codes, "s").select("code", "i")
    coded = written(coded.distinct(), "memberships")
    if base.schema["i"].dataType != T.LongType():
        ids = written(coded.groupBy("i").agg(F.count(F.lit(1)).alias("m")), "identifiers")
        book = numbered(ids, ["i"], "no")  # a number for each identifier: nothing is hashed
        parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        named = spread_join(coded, book.select("i", "no"), ["i"], book.where(F.col("m") > 100_000), ["code"], parts)
        coded = written(named.select("code", F.col("no").alias("i")), "memberships")
    sizes = written(coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "set-sizes")
    pairs = pair_products(coded, "i", "code", max_group=max_group).select("a", "b", F.col("n").alias("shared"))
    sized = pairs.join(sizes.select(F.col("code").alias("a"), F.col("n").alias("size_a")), "a").join(sizes.select(F.col("code").alias("b"), F.col("n").alias("size_b")), "b")
    if plain:
        return sized.select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), "shared", "size_a", "size_b")
    name = lambda end: codes.select(F.col("code").alias(end), F.col("s").alias(f"set_{end}"))
    return sized.join(name("a"), "a").join(name("b"), "b").select("set_a", "set_b", "shared", "size_a", "size_b")


def contained(pairs: DataFrame, one_in: int) -> DataFrame:
    """Pairs that share at least one in ``one_in`` identifiers of the smaller set."""
    return pairs.where(F.col("shared") * one_in >= F.least("size_a", "size_b"))


def nearest_sets(pairs: DataFrame, k: int) -> DataFrame:
    """(set, other, rank from 1, shared, jaccard): for each set the k others of greatest Jaccard similarity, smaller id first among equals."""
    jaccard = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    both = F.explode(F.array(F.struct(F.col("set_a").alias("set"), F.col("set_b").alias("other")), F.struct(F.col("set_b").alias("set"), F.col("set_a").alias("other"))))
    directed = pairs.select(both.alias("d"), "shared", jaccard.alias("jaccard")).select("d.set", "d.other", "shared", "jaccard")
    best = Window.partitionBy("set").orderBy(F.col("jaccard").desc(), "other")
    return directed.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)
