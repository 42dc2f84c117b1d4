"""Ranking metrics over users with at least one held-out item: precision, recall and NDCG at k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.shared import written
from .operators.interactions import as_interactions, item_universe, settled
from .operators.score import top_k
from .params import setting

__all__ = ["ndcg_at_k", "precision_at_k", "recall_at_k"]


def _checked_ranks(predictions: DataFrame, k: int, items: DataFrame | None) -> DataFrame:
    """(user, item, rank) of the first k places of written ranked ids; every user has to have k known, different ones."""
    first = predictions.where(F.col("rank") < k).select("user", "item", "rank")
    most = k if items is None else min(k, items.count())
    marked = first.withColumn("_known", F.lit(True)) if items is None else first.join(items.withColumn("_known", F.lit(True)), "item", "left")
    per_user = marked.groupBy("user").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("item").alias("different"),
        F.min(F.when(F.col("_known").isNull(), F.col("item"))).alias("stray"),
    )
    everyone = predictions.select("user").distinct().join(per_user, "user", "left")
    n = F.coalesce("n", F.lit(0))
    worst = everyone.agg(
        F.min(F.when(F.col("stray").isNotNull(), F.struct("user", "stray"))).alias("stray"),
        F.min(F.when(F.col("different") < n, F.struct("user"))).alias("twice"),
        F.min(F.when(n < most, F.struct("user", n.alias("n")))).alias("short"),
    ).first()
    if worst.stray is not None:
        raise ValueError(f"user {worst.stray.user} is predicted item {worst.stray.stray}, outside the given items")
    if worst.twice is not None:
        raise ValueError(f"user {worst.twice.user} is predicted an item that repeats among the first {k}")
    if worst.short is not None:
        raise ValueError(f"user {worst.short.user} has {worst.short.n} ranked items; at least k={most} are needed")
    return first


def _checked_scores(predictions: DataFrame, items: DataFrame | None, complete: bool) -> None:
    """Raises if written scores hold a null or NaN, a repeated cell, an item outside ``items``, or (``complete``) lack a cell."""
    per_user = predictions.groupBy("user").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("item").alias("different"),
        F.count_if(F.col("user").isNull() | F.col("item").isNull() | F.col("score").isNull() | F.isnan("score")).alias("void"),
    )
    worst = per_user.agg(
        F.sum("void").alias("void"),
        F.min(F.when(F.col("different") < F.col("n"), F.struct("user"))).alias("twice"),
        F.min(F.struct("n", "user")).alias("least"),
    ).first()
    if worst.void:
        raise ValueError(f"predictions hold {worst.void} scores that are null, NaN or without user or item")
    if worst.twice is not None:
        raise ValueError(f"predictions score an item twice for user {worst.twice.user}")
    if items is None:
        return
    stray = predictions.join(items, "item", "left_anti").select("user", "item").first()
    if stray is not None:
        raise ValueError(f"predictions score item {stray.item} for user {stray.user}, outside the given items")
    n_items = items.count()
    if complete and worst.least is not None and worst.least.n < n_items:
        raise ValueError(f"predictions score {worst.least.n} of {n_items} items for user {worst.least.user}")


def evaluate(predictions: DataFrame, test: DataFrame, k: int = 10, *, items: DataFrame | None = None, users: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """One row (precision_at_k, recall_at_k, ndcg_at_k, n_users). ``predictions`` are computed once.

    ``predictions`` is (user, item, rank) or (user, item, score), ``test`` the held-out (user, item, value). Users
    without held-out items do not count; with none at all every metric is 0. Precision divides by k. Both forms are
    checked for all users. Ranked ids: unknown ids (if ``items`` is given), repeated ids and too few ids raise ValueError.
    Scores: nulls, NaN, cells scored twice and unknown items do, and with ``complete`` cells of ``items`` without score, which
    otherwise stand behind all scored ones. A held-out user outside ``users``, if given, is a ValueError too.
    """
    k = setting("k", k)
    value = "value" if "value" in test.columns else None
    held = settled(as_interactions(test, value=value), "test_matrix")[0].select("user", "item")
    if users is not None:
        stray = held.join(users.select("user").distinct(), "user", "left_anti").first()
        if stray is not None:
            raise ValueError(f"test_matrix holds user {stray.user}, whom predictions do not cover")
    items = None if items is None else item_universe(items, items)
    width = k
    if "rank" in predictions.columns:
        ranked = _checked_ranks(written(predictions.select("user", "item", "rank"), "ranked"), k, items)
    elif "score" in predictions.columns:
        scores = written(predictions.select("user", "item", F.col("score").cast("double").alias("score")), "scored")
        _checked_scores(scores, items, complete)
        ranked = top_k(scores, k).select("user", "item", "rank")
        width = k if items is None else min(k, items.count())
    else:
        raise ValueError(f"predictions need a rank or a score column, got {predictions.columns}")
    gain = 1.0 / F.log2(F.col("rank") + 2.0)
    hits = ranked.join(held, ["user", "item"], "left_semi").groupBy("user").agg(F.count(F.lit(1)).alias("hits"), F.sum(gain).alias("dcg"))
    sizes = held.groupBy("user").agg(F.count(F.lit(1)).alias("n_test"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_test", F.lit(width)).cast("int")), F.lit(0.0), lambda s, j: s + 1.0 / F.log2(j + F.lit(1.0)))
    per_user = sizes.join(hits, "user", "left").select(
        (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("p"),
        (F.coalesce("hits", F.lit(0)) / F.col("n_test")).alias("r"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("g"),
    )
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    return per_user.agg(mean("p", "precision_at_k"), mean("r", "recall_at_k"), mean("g", "ndcg_at_k"), F.count(F.lit(1)).alias("n_users"))


def precision_at_k(predictions: DataFrame, test: DataFrame, k: int = 10, **kwargs: DataFrame | None) -> float:
    """Mean share of the first k that is held out; the divisor is always k."""
    return evaluate(predictions, test, k, **kwargs).first().precision_at_k


def recall_at_k(predictions: DataFrame, test: DataFrame, k: int = 10, **kwargs: DataFrame | None) -> float:
    """Mean share of a user's held-out items found among the first k."""
    return evaluate(predictions, test, k, **kwargs).first().recall_at_k


def ndcg_at_k(predictions: DataFrame, test: DataFrame, k: int = 10, **kwargs: DataFrame | None) -> float:
    """Mean of discounted gain over the best possible one; a hit at rank j (from 0) counts 1 / log2(j + 2)."""
    return evaluate(predictions, test, k, **kwargs).first().ndcg_at_k
