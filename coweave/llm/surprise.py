"""Items that appear together: exact pair counts against a fitted bipartite null model.

The null model (bipartite configuration model) is the maximum-entropy random membership of items in groups that keeps
the expected size of every item and of every group: item i is in group u with probability x_u y_i / (1 + x_u y_i),
independently. Under it the number of groups that hold both i and j is a sum of independent, unequal coin flips
(Poisson-binomial), whose upper tail at the observed count is the p-value; Benjamini-Hochberg over all pairs of
items gives q-values.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import BROADCAST_ROWS, broadcast_if_small, spread_join
from ..functions.shared import written
from ..operators.copairs import MAX_GROUP, pair_products

#: For the fit, sizes up to EXACT_SIZES are classes of their own, larger ones fall into classes 1 % wide: a few thousand at any scale.
#: Items get the factor of their exact size afterwards.
EXACT_SIZES = 256
CLASS_WIDTH = 0.01
#: p-values are ranked in steps of 1/50 of their natural logarithm, rounded up: q-values are at most 2 % too large.
P_STEPS = 50
LEAST_LOG_P = -745.0
#: Pairs that are worth a task of their own.
TASK_PAIRS = 250
#: Cells of windows that are transformed at once.
WINDOW_CELLS = 1 << 18
#: Coin flips below this probability enter a characteristic function by power sums, as many as leave an error below 1e-12.
SERIES_BELOW = 0.1
SERIES_TERMS = 20


def size_class(n: Column) -> Column:
    above = F.floor(F.log(n / F.lit(float(EXACT_SIZES))) / F.lit(float(np.log1p(CLASS_WIDTH)))) + EXACT_SIZES + 1
    return F.when(n <= EXACT_SIZES, n).otherwise(above).cast("int")


def _classes(sizes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(members, mean size) of the classes that occur; a few thousand rows however many members there are."""
    rows = sizes.groupBy(size_class(F.col("n")).alias("c")).agg(F.count(F.lit(1)).alias("m"), F.avg("n").alias("d")).orderBy("c").collect()
    return np.array([r.m for r in rows], dtype=np.float64), np.array([r.d for r in rows], dtype=np.float64)


@dataclass(frozen=True)
class Null:
    """The fitted null model: the logarithm ``u`` of the factor of each class of groups, their ``members``, and whether the fit has ``met`` all sizes."""

    u: np.ndarray
    members: np.ndarray
    met: bool

    def chances(self, sizes: np.ndarray) -> np.ndarray:
        """(item sizes x group classes): with which probability an item of exactly this size is in a group of the class.

        The item's own factor is the one root at which its probabilities add up to its size, found by Newton steps that stay
        inside a shrinking bracket.
        """
        if not len(self.u) or not len(sizes):
            return np.zeros((len(sizes), len(self.u)))
        goal = np.minimum(sizes.astype(np.float64), self.members.sum() * (1 - 1e-9))
        low, high = np.full(len(goal), -np.max(self.u) - 50.0), np.full(len(goal), -np.min(self.u) + 50.0)
        v = np.clip(np.log(goal) - np.log((np.exp(self.u) * self.members).sum()), low, high)
        for _ in range(200):
            p = 1.0 / (1.0 + np.exp(-(v[:, None] + self.u[None, :])))
            over = p @ self.members - goal
            low, high = np.where(over < 0, v, low), np.where(over > 0, v, high)
            if (np.abs(over) <= 1e-11 * goal).all():
                break
            following = v - over / np.maximum((p * (1 - p)) @ self.members, 1e-300)
            v = np.where((following > low) & (following < high), following, (low + high) / 2)
        return p


def fit_null(group_members: np.ndarray, group_size: np.ndarray, item_members: np.ndarray, item_size: np.ndarray, rounds: int = 2000, tol: float = 1e-7) -> Null:
    """The factors at which expected row and column sums are the mean sizes of classes of groups and items.

    Alternates Newton steps on log x and log y; the likelihood is concave in them. A class whose members hold
    everything gets probability 1 in the limit.
    """
    total = float((group_members * group_size).sum())
    if not total:
        return Null(np.empty(0), group_members, True)
    n_items, n_groups = item_members.sum(), group_members.sum()
    u = np.log(np.clip(group_size, 1e-12, None) / np.sqrt(total))
    v = np.log(np.clip(item_size, 1e-12, None) / np.sqrt(total))
    target_u, target_v = np.minimum(group_size, n_items * (1 - 1e-9)), np.minimum(item_size, n_groups * (1 - 1e-9))

    def table() -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(u[:, None] + v[None, :], -60, 60)))

    for _ in range(rounds):
        p = table()
        u += np.clip((target_u - p @ item_members) / np.maximum((p * (1 - p)) @ item_members, 1e-12), -1, 1)
        p = table()
        v += np.clip((target_v - group_members @ p) / np.maximum(group_members @ (p * (1 - p)), 1e-12), -1, 1)
        p = table()
        if np.abs(p @ item_members / target_u - 1).max() < tol and np.abs(group_members @ p / target_v - 1).max() < tol:
            return Null(u, group_members, True)
    return Null(u, group_members, False)


def log_tail(members: np.ndarray, q: np.ndarray, k: np.ndarray) -> np.ndarray:
    """ln P(V >= k) for V the sum of ``members[c]`` coin flips of probability ``q[:, c]``, one row per pair.

    The distribution is tilted so that its mean is k, the tilted probabilities come from a discrete Fourier transform
    over a window around k, and the tilt is taken back: far tails keep full relative precision.
    """
    k = k.astype(np.float64)
    q = np.clip(q, 0.0, 1.0 - 1e-12)
    mean = q @ members
    s = np.zeros(len(k))
    up = (k > mean) & (mean > 0)
    if up.any():
        a, most = q[up], float(members.sum())
        goal = np.minimum(k[up], most - 1e-6)
        t = np.log(np.maximum(goal / np.maximum(mean[up], 1e-300), 1.0))
        for _ in range(60):
            e = a * np.exp(np.minimum(t, 700.0))[:, None]
            r = e / (1 - a + e)
            step = (r @ members - goal) / np.maximum((r * (1 - r)) @ members, 1e-12)
            t = np.maximum(t - np.clip(step, -2, 2), 0.0)
            if np.abs(step).max() < 1e-10:
                break
        s[up] = t
    e = q * np.exp(np.minimum(s, 700.0))[:, None]
    r = e / (1 - q + e)
    cumulant = np.log1p(q * np.expm1(np.minimum(s, 700.0))[:, None]) @ members
    centre = np.where(up, np.round(k), np.round(mean)).astype(np.int64)
    half = 2 ** np.ceil(np.log2(12 * np.sqrt((r * (1 - r)) @ members) + 24)).astype(np.int64)
    out = np.empty(len(k))
    for width in np.unique(half).tolist():  # pairs of one width of window share their transform
        same = np.flatnonzero(half == width)
        step = max(1, WINDOW_CELLS // width)
        for lo in range(0, len(same), step):
            at = same[lo : lo + step]
            out[at] = _window(members, r[at], k[at], s[at], centre[at], cumulant[at], width)
    return np.where((mean <= 0) & (k > 0), LEAST_LOG_P, out)


def _window(members: np.ndarray, r: np.ndarray, k: np.ndarray, s: np.ndarray, centre: np.ndarray, cumulant: np.ndarray, half: int) -> np.ndarray:
    """`log_tail` of pairs with tilted probabilities ``r``, from windows of ``half`` values to either side of ``centre``."""
    window = 2 * half
    turn = np.exp(2j * np.pi * np.arange(half + 1) / window) - 1
    # ln(1 + r turn) of rare flips as a series in turn: one power sum per term stands for all classes
    rare = np.where(r < SERIES_BELOW, r, 0.0)
    sums, power = np.empty((len(k), SERIES_TERMS)), np.ones_like(rare)
    for j in range(SERIES_TERMS):
        power *= rare
        sums[:, j] = power @ members
    order = np.arange(1, SERIES_TERMS + 1)
    logs = sums @ (-((-turn[None, :]) ** order[:, None]) / order[:, None])
    # the other flips one by one, a bounded number of them at once
    row, flip = np.nonzero(r >= SERIES_BELOW)
    for lo in range(0, len(row), max(1, WINDOW_CELLS // half)):
        cut = slice(lo, lo + max(1, WINDOW_CELLS // half))
        terms = members[flip[cut], None] * np.log(1 + r[row[cut], flip[cut], None] * turn[None, :])
        starts = np.r_[0, np.flatnonzero(np.diff(row[cut])) + 1]
        logs[row[cut][starts]] += np.add.reduceat(terms, starts, axis=0)
    pmf = np.fft.irfft(np.conj(np.exp(logs)), window, axis=1)
    at = centre[:, None] + np.arange(-half, half)[None, :]
    mass = np.maximum(np.take_along_axis(pmf, at % window, axis=1), 0.0)
    above = (at >= k[:, None]) & (at >= 0)
    tail = np.where(above, mass * np.exp(-s[:, None] * np.where(above, at - k[:, None], 0.0)), 0.0).sum(axis=1)
    found = np.minimum(0.0, np.log(np.maximum(tail, 1e-300)) + cumulant - s * k)
    return np.where((k <= centre - half) | (k <= 0), 0.0, found)


@dataclass(frozen=True)
class Cooccurrence:
    """``pairs``: (item_a, item_b, n_ab, n_a, n_b, lift, expected, log_p, q_value), item_a < item_b; ``n_groups``, ``n_items`` over all rows;
    ``fitted``: whether the null model keeps all sizes."""

    pairs: DataFrame
    n_groups: int
    n_items: int
    fitted: bool


def cooccurrence(rows: DataFrame, group: str, item: str, *, min_count: int = 1, min_lift: float = 0.0, max_group: int = MAX_GROUP) -> Cooccurrence:
    """Pairs of items with at least ``min_count`` common groups and ``n_ab * n_groups >= min_lift * n_a * n_b``, with their surprise.

    ``rows`` has bigint ``group`` and ``item``; nulls in either are left out, repeated rows count once, other columns are
    ignored. An empty table gives no pairs. Both limits are used before pairs are formed, exactly: an item of
    fewer than ``min_count`` groups, or of more than n_groups / min_lift, is in no such pair. The null model is fitted to
    all rows nonetheless. q-values take every pair of items as tested; pairs below the limits get no rank, so with limits
    q-values are upper bounds.
    """
    if min_count < 1:
        raise ValueError(f"min_count must be >= 1, got {min_count}")
    base = rows.select(F.col(group).alias("g"), F.col(item).alias("e")).where(F.col("g").isNotNull() & F.col("e").isNotNull())
    base = written(base.distinct(), "memberships")
    items = written(base.groupBy("e").agg(F.count(F.lit(1)).alias("n")), "item-sizes")
    groups = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    group_members, group_size = _classes(groups)
    item_members, item_size = _classes(items)
    n_groups, n_items = int(group_members.sum()), int(item_members.sum())
    null = fit_null(group_members, group_size, item_members, item_size)
    if not null.met:
        warnings.warn("the null model does not keep all sizes: expected counts and p-values are approximate", RuntimeWarning, stacklevel=2)

    fits = (F.col("n") >= min_count) & (F.col("n") * F.lit(float(min_lift)) <= F.lit(float(n_groups)))
    kept = items.where(fits)
    n_kept = kept.count()
    inner = base
    if n_kept < n_items:
        if n_kept <= BROADCAST_ROWS:
            inner = base.join(F.broadcast(kept.select("e")), "e", "left_semi")
        else:
            parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            inner = spread_join(base, kept.select("e"), ["e"], kept.where(F.col("n") > max(1, n_groups // parts)), ["g"], parts)
    counts = pair_products(inner, "g", "e", min_count=min_count, max_group=max_group).select("a", "b", F.col("n").alias("n_ab"))
    sized = lambda end: broadcast_if_small(kept, n_kept).select(F.col("e").alias(end), F.col("n").alias(f"n_{end}"))
    counts = counts.join(sized("a"), "a").join(sized("b"), "b")
    counts = counts.where(F.col("n_ab") * F.lit(float(n_groups)) >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    counts = written(counts.select("a", "b", "n_ab", "n_a", "n_b"), "pair-counts")
    counts = counts.withColumn("low", F.least("n_a", "n_b")).withColumn("high", F.greatest("n_a", "n_b"))
    case = ["low", "high", "n_ab"]  # pairs of one case have the same tail, which is computed once
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cases = counts.groupBy(*case).agg(F.count(F.lit(1)).alias("m"))
    # equal shares of cases to tasks, those of like counts together: they need windows of like size; a task has some hundred cases at least
    tasks = max(1, min(4 * parts, -(-counts.count() // TASK_PAIRS)))
    cases = cases.repartition(tasks, *case).sortWithinPartitions("n_ab", "low", "high")
    shared = base.sparkSession.sparkContext.broadcast(null)  # a few thousand classes

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            low, high, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in case)
            logs, means = np.empty(len(n)), np.empty(len(n))
            for lo in range(0, len(n), 1024):
                one = slice(lo, lo + 1024)
                sizes, at = np.unique(np.concatenate([low[one], high[one]]), return_inverse=True)
                p, m = known.chances(sizes), len(low[one])
                q = p[at[:m]] * p[at[m:]]
                means[one] = q @ known.members
                logs[one] = log_tail(known.members, q, n[one])
            cols = [batch.column(c) for c in (*case, "m")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(means), pa.array(logs)], names=[*case, "m", "expected", "log_p"])

    tested = written(cases.mapInArrow(tails, "low bigint, high bigint, n_ab bigint, m bigint, expected double, log_p double"), "surprise")
    n_cases = tested.count()
    step = F.floor(-F.greatest(F.col("log_p"), F.lit(LEAST_LOG_P)) * P_STEPS).cast("int")
    # at most 37,251 steps, whatever the number of pairs
    bins = tested.groupBy(step.alias("step")).agg(F.sum("m").alias("m")).orderBy(F.col("step").desc()).collect()
    rank = np.cumsum([r.m for r in bins]) if bins else np.empty(0)
    tests = n_items * (n_items - 1) / 2
    q = np.array([np.exp(-r.step / P_STEPS) for r in bins]) * tests / rank if bins else np.empty(0)
    q = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1.0) if bins else q
    book = base.sparkSession.createDataFrame([(int(r.step), float(x)) for r, x in zip(bins, q, strict=True)], "step int, q_value double")
    known = tested.withColumn("step", step).join(F.broadcast(book), "step", "left").select(*case, "expected", "log_p", "q_value")
    if n_cases <= BROADCAST_ROWS:
        pairs = counts.join(F.broadcast(known), case)
    else:
        pairs = spread_join(counts, known, case, tested.where(F.col("m") > 100_000), ["a", "b"], parts)
    lift = F.col("n_ab") * F.lit(float(n_groups)) / (F.col("n_a") * F.col("n_b"))
    return Cooccurrence(
        pairs.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b", lift.alias("lift"), "expected", "log_p", "q_value"),
        n_groups,
        n_items,
        null.met,
    )
