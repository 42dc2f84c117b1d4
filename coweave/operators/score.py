"""Scoring and ranking: history times weights, seen items out, best k per user.

Weights of a counted, bounded size are laid out once as a sorted table in every worker, and a user's history is scored and
ranked where it lies: one shuffle of the histories and none of products. Larger weights are joined with the histories.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import BROADCAST_ROWS, spread_join
from ..functions.shared import written
from ..functions.sums import exact_sum, limbs, numbered, ordered_sum
from ..params import setting
from .interactions import Facts, as_interactions, is_finite, item_universe, settled, user_universe
from .weight_table import WeightTable, places

#: Rows under one item from which its histories are spread over several tasks in the shuffled join.
HOT_ROWS = 100_000
#: Most weights, and most items, that are laid out as a table in every worker (some 50 MB and 16 MB).
TABLE_WEIGHTS = 4_000_000
TABLE_ITEMS = 2_000_000


def as_weights(weights: DataFrame) -> DataFrame:
    """(source, target, weight: double); raises ValueError if a column is missing."""
    missing = [c for c in ("source", "target", "weight") if c not in weights.columns]
    if missing:
        raise ValueError(f"weights need the columns source, target and weight; {missing} not found in {weights.columns}")
    return weights.select("source", "target", F.col("weight").cast("double").alias("weight"))


@dataclass(frozen=True)
class Model:
    """Written ``weights`` with their number and magnitudes."""

    weights: DataFrame
    facts: Facts


def prepare_weights(weights: DataFrame) -> Model:
    """Weights written once and looked at once: null ids and null or non-finite weights raise ValueError."""
    w = written(as_weights(weights), "weights")
    c = F.col("weight")
    bad = F.col("source").isNull() | F.col("target").isNull() | c.isNull() | ~is_finite(c)
    size = F.when(c != 0, F.abs(c))
    found = w.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad).alias("bad"),
        F.coalesce(F.bool_and(c == F.floor(c)), F.lit(True)).alias("whole"),
        F.max(size).alias("largest"),
        F.min(size).alias("least"),
    ).first()
    if found.bad:
        raise ValueError(f"weights must hold ids and finite weights only, but {found.bad} rows do not")
    return Model(w, Facts(found.rows, bool(found.whole), found.largest or 0.0, found.least or 0.0))


def prepare_history(history: DataFrame, items: DataFrame | None, user_col: str, item_col: str, value_col: str | None) -> tuple[DataFrame, Facts]:
    """Histories written as (user, item, value) with one row per cell and no zeros; negative values are allowed, nulls and non-finite ones are not."""
    h, facts = settled(as_interactions(history, user_col, item_col, value_col), "user_history", signed=True)
    if items is not None:
        stray = h.join(item_universe(h, items), "item", "left_anti").select("item").first()
        if stray is not None:
            raise ValueError(f"user_history holds item {stray.item}, which the weights do not describe")
    return h, facts


def parallel(spark: SparkSession) -> int:
    """Tasks of a stage that computes more than it reads."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _summed(joined: DataFrame, term: Column, values: Facts, weights: Facts) -> DataFrame:
    """(user, target, score) of products ``term``: exact sums, which need no order, or a fold in the order of items where they cannot be held."""
    keys = ["user", "target"]
    most = values.rows  # terms of one user and target: never more than there are cells
    largest = values.largest * weights.largest
    if values.integral and weights.integral and largest * most < 2.0**53:
        return joined.groupBy(*keys).agg(F.sum(term).alias("score"))
    layout = limbs(largest, values.least * weights.least, most)
    return exact_sum(joined, keys, term, layout, "score") if layout else ordered_sum(joined, keys, term, F.col("_item"), "score")


def score_pairs(history: DataFrame, model: Model, facts: Facts) -> DataFrame:
    """(user, item, score) wherever a history meets a weight: a join and a sum, for weights beyond the table.

    Weights of at most BROADCAST_ROWS rows (counted) are broadcast; larger ones are joined by shuffle, the rows of
    popular items spread over tasks. Scores do not depend on partitioning.
    """
    w = model.weights.select(F.col("source").alias("_item"), "target", "weight")
    h = history.select("user", F.col("item").alias("_item"), "value")
    if model.facts.rows <= BROADCAST_ROWS:
        joined = h.join(F.broadcast(w), "_item")
    else:
        hot = h.groupBy("_item").count().where(F.col("count") > HOT_ROWS)
        joined = spread_join(h, w, ["_item"], hot, ["user"], parallel(history.sparkSession))
    scored = _summed(joined, F.col("value") * F.col("weight"), facts, model.facts)
    return scored.select("user", F.col("target").alias("item"), "score")


def _table(model: Model, universe: DataFrame) -> Broadcast[WeightTable]:
    """The weights (at most TABLE_WEIGHTS) between the items (at most TABLE_ITEMS) of the universe; both were counted before."""
    cells = model.weights.toArrow()
    ids = lambda column: column.to_numpy() if len(column) else np.empty(0, np.int64)
    names = np.sort(ids(universe.toArrow().column("item")))
    table = WeightTable.of(names, ids(cells.column("source")), ids(cells.column("target")), ids(cells.column("weight")))
    return universe.sparkSession.sparkContext.broadcast(table)


def _by_user(history: DataFrame, table: Broadcast[WeightTable], answer: Callable[[WeightTable, np.ndarray, np.ndarray], tuple[np.ndarray, ...]], extra: str) -> DataFrame:
    """Rows of ``answer`` (items, further columns named by ``extra``) for every user; a row without item stands for a user without history.

    One shuffle, of the histories. A user has at most one row per item of the table, so a task's memory is bounded.
    """
    user, item = (history.schema[c].dataType.simpleString() for c in ("user", "item"))
    laid = history.repartition(parallel(history.sparkSession), "user").sortWithinPartitions("user", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        whole, part = [], None  # answered users; the user who may go on in the next batch

        def answered(who: pa.Scalar, pieces: list[tuple[np.ndarray, np.ndarray]]) -> None:
            held, values = (np.concatenate(x) for x in zip(*pieces, strict=True))
            whole.append((who, *answer(known, held, values)))

        def out(kinds: list[pa.DataType]) -> pa.RecordBatch:
            sizes = [len(w[1]) for w in whole]
            who = pa.array([w[0] for w in whole], kinds[0]).take(pa.array(np.repeat(np.arange(len(whole)), sizes)))
            cols = [np.concatenate(x) for x in list(zip(*whole, strict=True))[1:]]
            whole.clear()
            items = pa.array(known.names[cols[0]], kinds[1])
            return pa.RecordBatch.from_arrays([who, items, *(pa.array(c) for c in cols[1:])], names=["user", "item", *(c.split()[0] for c in extra.split(", "))])

        kinds: list[pa.DataType] = []
        waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.column(0).type, batch.column(1).type]
            who, there = batch.column(0).to_pylist(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            items, values = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            names = items.fill_null("" if pa.types.is_string(items.type) else 0).to_numpy(zero_copy_only=False)
            at = places(known.names, names)
            cuts = [k for k in range(1, len(who)) if who[k] != who[k - 1]]
            for lo, hi in zip([0, *cuts], [*cuts, len(who)], strict=True):
                use = there[lo:hi] & (at[lo:hi] >= 0)
                piece = at[lo:hi][use], values[lo:hi][use]
                if part is not None and part[0] == who[lo]:
                    part[1].append(piece)
                    continue
                if part is not None:
                    answered(*part)
                    waiting += len(whole[-1][1])
                part = who[lo], [piece]
                if waiting > 50_000:
                    yield out(kinds)
                    waiting = 0
        if part is not None:
            answered(*part)
        if whole:
            yield out(kinds)

    return laid.mapInArrow(run, f"user {user}, item {item}, {extra}")


def unseen(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of ``pairs`` whose (user, item) is not in the history."""
    return pairs.join(history.select("user", "item"), ["user", "item"], "left_anti")


def _scored(h: DataFrame, facts: Facts, model: Model, items: DataFrame | None, exclude_seen: bool) -> DataFrame:
    """(user, item, score) wherever a history meets a weight, seen items out if asked: by the table if it may be laid out, else by a join."""
    if model.facts.rows <= TABLE_WEIGHTS:
        universe = written(item_universe(_known_items(model.weights, h), items).unionByName(_known_items(model.weights, h)).distinct(), "universe")
        if universe.count() <= TABLE_ITEMS:
            return _by_user(h, _table(model, universe), lambda t, at, v: t.scores(at, v, exclude_seen), "score double")
    scored = score_pairs(h, model, facts)
    return unseen(scored, h) if exclude_seen else scored


def predict(
    weights: DataFrame,
    user_history: DataFrame,
    *,
    exclude_seen: bool = True,
    batch_size: int | None = None,
    dense: bool = False,
    items: DataFrame | None = None,
    users: DataFrame | None = None,
    user_col: str = "user",
    item_col: str = "item",
    value_col: str | None = "value",
) -> DataFrame:
    """(user, item, score) = history times weights.

    Rows without a score are left out and stand for 0; seen items are left out if ``exclude_seen``. With ``dense=True``
    every user meets every item of the universe, scores default to 0 and seen items get -inf: that result has
    users x items rows by definition. ``batch_size`` is checked and has no effect: Spark streams partitions. Scores do not
    depend on partitioning.
    """
    setting("batch_size", batch_size)
    model = prepare_weights(weights)
    h, facts = prepare_history(user_history, items, user_col, item_col, value_col)
    if not dense:
        return _scored(h, facts, model, items, exclude_seen)
    scored = _scored(h, facts, model, items, False)
    universe = item_universe(_known_items(model.weights, h), items)
    grid = user_universe(h, users).crossJoin(universe)  # the dense form asks for every cell
    seen = h.select("user", "item", F.lit(True).alias("_seen"))
    filled = grid.join(scored, ["user", "item"], "left").join(seen, ["user", "item"], "left")
    score = F.coalesce("score", F.lit(0.0))
    return filled.select("user", "item", (F.when(F.col("_seen"), F.lit(float("-inf"))).otherwise(score) if exclude_seen else score).alias("score"))


def _known_items(w: DataFrame, h: DataFrame) -> DataFrame:
    return w.select(F.col("source").alias("item")).union(w.select("target")).union(h.select("item"))


def top_k(scores: DataFrame, k: int, by: str = "user") -> DataFrame:
    """(by, rank from 0, item, score): the k best rows of each group, smaller item first among equal scores."""
    best = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("item").asc())
    ranked = scores.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k)
    return ranked.select(by, (F.col("_place") - 1).alias("rank"), "item", "score")


def recommend(
    weights: DataFrame,
    user_history: DataFrame,
    k: int = 10,
    *,
    exclude_seen: bool = True,
    batch_size: int | None = None,
    items: DataFrame | None = None,
    users: DataFrame | None = None,
    user_col: str = "user",
    item_col: str = "item",
    value_col: str | None = "value",
) -> DataFrame:
    """(user, rank from 0, item, score): exactly min(k, number of items) rows per user.

    Order: positive scores, then items without score by id, then negative scores, then (with ``exclude_seen``) seen
    items by id with score -inf; ties go to the smaller id. ``users`` adds users without history. The ranking does not
    depend on partitioning.
    """
    setting("batch_size", batch_size)
    k = setting("k", k)
    model = prepare_weights(weights)
    h, facts = prepare_history(user_history, items, user_col, item_col, value_col)
    universe = written(item_universe(_known_items(model.weights, h), items), "universe")
    n_items = universe.count()
    k = min(k, n_items)
    if not k:
        return _ranked(h.select("user", "item", F.col("value").alias("score"), F.lit(0).alias("kind")), 0)
    if model.facts.rows <= TABLE_WEIGHTS and n_items <= TABLE_ITEMS:
        rows = h
        if users is not None:
            lone = user_universe(h, users).join(h, "user", "left_anti")
            rows = h.unionByName(lone.select("user", F.lit(None).cast(h.schema["item"].dataType).alias("item"), F.lit(None).cast("double").alias("value")))

        def best(t: WeightTable, at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
            found, scores = t.best(at, v, k, exclude_seen)
            return found, np.arange(len(found), dtype=np.int32), scores

        return _by_user(rows, _table(model, universe), best, "rank int, score double").select("user", "rank", "item", "score")
    if items is not None:
        model = Model(_within(model.weights, universe), model.facts)
    return _filled(score_pairs(h, model, facts), h, user_universe(h, users), universe, n_items, k, exclude_seen)


def _within(w: DataFrame, known: DataFrame) -> DataFrame:
    """Weights between known items."""
    return w.join(known.withColumnRenamed("item", "source"), "source", "left_semi").join(known.withColumnRenamed("item", "target"), "target", "left_semi").select("source", "target", "weight")


def _filled(scored: DataFrame, h: DataFrame, everyone: DataFrame, universe: DataFrame, n_items: int, k: int, exclude_seen: bool) -> DataFrame:
    """The ranking of `recommend` from scored pairs. Nothing is crossed with the universe: free ids are found as gaps among the ranks a user already has."""
    scored = scored.where(F.col("score") != 0)
    scored = written(unseen(scored, h) if exclude_seen else scored, "scores")
    taken = scored.select("user", "item", "score", F.when(F.col("score") > 0, 0).otherwise(2).alias("kind"))
    short = (
        everyone.join(taken.where("kind = 0").groupBy("user").agg(F.count(F.lit(1)).alias("_have")), "user", "left")
        .select("user", (F.lit(k) - F.least(F.coalesce("_have", F.lit(0)), F.lit(k))).cast("int").alias("_free"))
        .where(F.col("_free") > 0)
    )
    if short.isEmpty():
        return _ranked(taken, k)
    ranks = numbered(universe, ["item"], "_rank")
    blocked = taken.select("user", "item")
    if exclude_seen:
        blocked = blocked.union(h.select("user", "item"))
    held = blocked.join(short, "user", "left_semi").join(ranks, "item").select("user", "_rank")
    # the j-th held rank (j from 0) leaves rank - j free ranks before it: only held ranks with fewer than _free before them matter
    place = Window.partitionBy("user").orderBy("_rank")
    held = held.withColumn("_before", F.col("_rank") - F.row_number().over(place) + 1).join(short, "user").where(F.col("_before") < F.col("_free"))
    # free ranks lie in the gaps between them: a gap begins after each held rank, and at 0
    firsts = short.select("user", F.lit(-1).cast("bigint").alias("_rank"), F.lit(0).cast("bigint").alias("_before"), "_free")
    ends = Window.partitionBy("user").orderBy("_rank")
    gaps = firsts.unionByName(held.select("user", "_rank", "_before", "_free"))
    gaps = gaps.withColumn("_stop", F.coalesce(F.lead("_rank").over(ends), F.lit(n_items)))
    last = F.least(F.col("_stop") - 1, F.col("_rank") + F.col("_free") - F.col("_before"))
    gaps = gaps.where(last > F.col("_rank")).select("user", F.explode(F.sequence(F.col("_rank") + 1, last)).alias("_rank"))
    empty = gaps.join(ranks, "_rank").select("user", "item", F.lit(0.0).alias("score"), F.lit(1).alias("kind"))
    everything = taken.unionByName(empty)
    if exclude_seen:
        seen = h.join(short, "user", "left_semi").select("user", "item", F.lit(float("-inf")).alias("score"), F.lit(3).alias("kind"))
        everything = everything.unionByName(seen)
    return _ranked(everything, k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("user").orderBy("kind", F.col("score").desc(), F.col("item").asc())
    placed = rows.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k)
    return placed.select("user", (F.col("_place") - 1).alias("rank"), "item", "score")


def explain(weights: DataFrame, user_history: DataFrame, recommended: DataFrame) -> DataFrame:
    """(user, item, source, part): what each history item adds to the score of a recommended item."""
    h = user_history.select("user", F.col("item").alias("source"), "value")
    joined = recommended.select("user", "item").join(as_weights(weights).withColumnRenamed("target", "item"), "item").join(h, ["user", "source"])
    return joined.select("user", "item", "source", (F.col("value") * F.col("weight")).alias("part"))
