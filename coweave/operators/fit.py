"""Fitting item-item weights."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import spread_join
from ..functions.shared import written
from ..functions.sums import exact_sum, limbs, numbered, ordered_sum, running_offsets
from ..params import SolverParams
from . import kernel
from .gram import candidates, gram, mirrored, refuse_overflow, upper_half
from .interactions import as_interactions, item_universe, settled

#: Most cells that are sent to every worker as one matrix (about 100 MB). Larger inputs are solved block by block.
BROADCAST_CELLS = 4_000_000
#: Cells of the Gram matrix per block of targets on the blocked way, and candidates of a target beyond which it is solved on a growing set.
BLOCK_CELLS = 2_000_000
WIDE = 1000
#: Times that such a set may grow; a target that still wants more is stated as not converged.
WIDE_ROUNDS = 100
#: Rows under one id from which the rows are spread over several tasks where ids are replaced by codes.
HOT_ROWS = 100_000


class ConvergenceWarning(UserWarning):
    """Some items used up ``max_iter`` passes; their weights are feasible but not optimal."""


@dataclass(frozen=True)
class Solution:
    """Result of a fit: ``weights`` (source, target, weight) and ``diagnostics`` (item, n_passes, converged), both written."""

    weights: DataFrame
    diagnostics: DataFrame
    n_items: int
    n_unconverged: int


def _solution_schema(item_type: str) -> str:
    return f"target {item_type}, sources array<{item_type}>, weights array<double>, n_passes bigint, converged boolean"


def _rows(targets: list, sources: list, weights: list, passes: list, converged: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(targets, kind),
            pa.array(sources, pa.list_(kind)),
            pa.array(weights, pa.list_(pa.float64())),
            pa.array(passes, pa.int64()),
            pa.array(converged, pa.bool_()),
        ],
        names=["target", "sources", "weights", "n_passes", "converged"],
    )


class MatrixRows:
    """Gram rows on demand from a matrix that fits a worker: both orientations as sorted arrays."""

    def __init__(self, user: np.ndarray, item: np.ndarray, value: np.ndarray, n_users: int, n_items: int) -> None:
        self.n_items = n_items
        by_user = np.lexsort((item, user))
        self.row_start = np.r_[0, np.cumsum(np.bincount(user, minlength=n_users))]
        self.row_item, self.row_value = item[by_user].astype(np.int32), value[by_user]
        by_item = np.lexsort((user, item))
        self.col_start = np.r_[0, np.cumsum(np.bincount(item, minlength=n_items))]
        self.col_user, self.col_value = user[by_item].astype(np.int32), value[by_item]
        self.diag = np.bincount(item[by_item], weights=self.col_value**2, minlength=n_items)

    def row(self, k: int) -> np.ndarray:
        """Dense row k; terms are added in the order of users."""
        users = self.col_user[self.col_start[k] : self.col_start[k + 1]]
        values = self.col_value[self.col_start[k] : self.col_start[k + 1]]
        lengths = self.row_start[users + 1] - self.row_start[users]
        shift = self.row_start[users] - np.r_[0, np.cumsum(lengths)[:-1]]
        at = np.repeat(shift, lengths) + np.arange(int(lengths.sum()))
        return np.bincount(self.row_item[at], weights=self.row_value[at] * np.repeat(values, lengths), minlength=self.n_items)

    def solve(self, i: int, p: SolverParams) -> tuple[np.ndarray, np.ndarray, int, bool]:
        if self.col_start[i] == self.col_start[i + 1]:
            return np.empty(0, np.int64), np.empty(0), 0, True
        line = self.row(i)
        wanted = (line != 0) & (line >= p.lambd)
        wanted[i] = False
        cand = np.flatnonzero(wanted)
        w, passes, done = kernel.solve(line[cand], self.diag[cand], lambda t: self.row(int(cand[t]))[cand], p.lambd, p.beta, p.max_iter, p.tol)
        keep = w > 0
        return cand[keep], w[keep], passes, done


def _solve_broadcast(x: DataFrame, universe: DataFrame | None, p: SolverParams) -> DataFrame:
    """The solve with the matrix in each worker; without ``universe`` the items that occur are solved."""
    spark = x.sparkSession
    table = x.select("user", "item", "value").toArrow().to_pandas()  # at most BROADCAST_CELLS rows, counted before
    kind = x.schema["item"].dataType
    items = np.unique(table["item"].to_numpy()) if universe is None else np.sort(universe.toArrow().to_pandas()["item"].to_numpy())
    user, users = pd.factorize(table["user"], sort=True)
    item = np.searchsorted(items, table["item"].to_numpy())
    shared = spark.sparkContext.broadcast((MatrixRows(user, item, table["value"].to_numpy(), len(users), len(items)), items))
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, names = shared.value
        for batch in batches:
            found = [(i, *matrix.solve(i, p)) for i in batch.column(0).to_pylist()]
            if found:
                at, sources, weights, passes, done = zip(*found, strict=True)
                yield _rows([names[i] for i in at], [names[s] for s in sources], list(weights), list(passes), list(done), arrow)

    parts = max(4 * spark.sparkContext.defaultParallelism, -(-len(items) // 5000))
    return spark.range(len(items)).repartition(parts, "id").mapInArrow(run, _solution_schema(kind.simpleString()))


_EMPTY_COLUMNS = ("cast(array() as array<bigint>) as sources", "cast(array() as array<double>) as weights", "cast(0 as bigint) as n_passes", "true as converged")


def _strongest(rows: DataFrame, by: str, most: int) -> DataFrame:
    """Per item the ``most`` rows of greatest ``by``, smaller neighbor first among equals; ranked in hashed parts first, so no task sorts all rows of an item."""
    best = F.col(by).desc(), F.col("neighbor")
    part = F.pmod(F.xxhash64("neighbor"), F.lit(64))
    some = rows.withColumn("_r", F.row_number().over(Window.partitionBy("item", part).orderBy(*best))).where(F.col("_r") <= most)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("_r") <= most).drop("_r")


def _solve_within(active: DataFrame, half: DataFrame, p: SolverParams, block_cells: int) -> DataFrame:
    """Solutions of the targets in ``active`` (item, neighbor, p) over these candidates alone.

    Targets are laid into blocks by a running sum of their cells, so a block holds at most ``block_cells`` cells of the Gram matrix
    besides those of one target, and it gets the entries its targets ask for and no others.
    """
    active = written(active.select("item", "neighbor", "p"), "active")
    sizes = active.groupBy("item").agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("cells"))
    blocks = running_offsets(written(sizes, "cells"), ["item"], "cells", "at").select("item", F.expr(f"at div {block_cells}").alias("block"))
    wanted = written(active.join(blocks, "item"), "wanted")
    one, two = wanted.select("block", "item", F.col("neighbor").alias("k")), wanted.select("item", F.col("neighbor").alias("j"))
    cells = one.join(two, "item").where(F.col("k") <= F.col("j")).select("block", "k", "j").distinct()
    stored = half.select(F.col("item").alias("k"), F.col("neighbor").alias("j"), F.col("p").alias("q"))
    # renamed: both sides of the cogroup stem from one frame
    cells = cells.join(stored, ["k", "j"]).select(F.col("block").alias("of"), "k", "j", "q")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        k, j, q = (right.column(c).to_numpy() for c in ("k", "j", "q"))
        i, c, s = (left.column(n).to_numpy() for n in ("item", "neighbor", "p"))
        names = np.unique(c)
        key = np.searchsorted(names, k) * len(names) + np.searchsorted(names, j)
        order = np.argsort(key)
        key, q = key[order], q[order]

        def entry(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Entries at places of ``names``, 0 where none is stored."""
            want = np.minimum(x, y) * len(names) + np.maximum(x, y)
            at = np.searchsorted(key, want)
            at[at == len(key)] = 0
            return np.where(key[at] == want, q[at], 0.0) if len(key) else np.zeros(len(want))

        order = np.lexsort((c, i))
        i, c, s = i[order], c[order], s[order]
        cuts = np.flatnonzero(np.diff(i)) + 1
        out: list[tuple] = []
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(i)], strict=True):
            if lo == hi:
                continue
            own = np.searchsorted(names, c[lo:hi])
            line = lambda t, own=own: entry(np.full(len(own), own[t]), own)
            w, passes, done = kernel.solve(s[lo:hi], entry(own, own), line, p.lambd, p.beta, p.max_iter, p.tol)
            keep = w > 0
            out.append((int(i[lo]), c[lo:hi][keep], w[keep], passes, done))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.Table.from_batches([_rows(*map(list, cols), pa.int64())])

    return wanted.groupBy("block").cogroup(cells.groupBy("of")).applyInArrow(run, _solution_schema("bigint"))


def _entering(found: DataFrame, cand: DataFrame, entries: DataFrame, p: SolverParams) -> DataFrame:
    """(item, neighbor, p, step): candidates without weight that would enter by ``tol`` or more, of the converged targets in ``found``."""
    w = found.where("converged").select(F.col("target").alias("item"), F.explode_outer(F.arrays_zip("sources", "weights")).alias("z"))
    w = written(w.select("item", F.col("z.sources").alias("source"), F.col("z.weights").alias("weight")), "wide-weights")
    e, term = entries.select(F.col("item").alias("neighbor"), F.col("neighbor").alias("source"), "p"), F.col("p") * F.col("weight")
    sizes = [df.agg(F.max(F.abs(c)).alias("hi"), F.min(F.when(c != 0, F.abs(c))).alias("lo"), F.count(F.lit(1)).alias("n")).first() for df, c in ((entries, F.col("p")), (w, F.col("weight")))]
    joined = e.join(w.where("source is not null"), "source")
    layout = limbs((sizes[0].hi or 0.0) * (sizes[1].hi or 0.0), (sizes[0].lo or 1.0) * (sizes[1].lo or 1.0), max(sizes[1].n, 1))
    fitted = exact_sum(joined, ["item", "neighbor"], term, layout, "fit") if layout else ordered_sum(joined, ["item", "neighbor"], term, F.col("source"), "fit")
    curvature = entries.where(F.col("item") == F.col("neighbor")).select("neighbor", (F.col("p") + p.beta).alias("curvature"))
    rows = cand.join(w.select("item").distinct(), "item", "left_semi").join(w.select("item", F.col("source").alias("neighbor"), "weight"), ["item", "neighbor"], "left")
    rows = rows.where("weight is null").join(fitted, ["item", "neighbor"], "left").join(curvature, "neighbor").where("curvature > 0")
    step = (F.col("p") - F.coalesce("fit", F.lit(0.0)) - F.lit(p.lambd)) / F.col("curvature")
    return rows.withColumn("step", step).where(F.col("step") >= p.tol).select("item", "neighbor", "p", "step")


def _solve_blocks(x: DataFrame, universe: DataFrame, p: SolverParams, integral: bool, block_cells: int = BLOCK_CELLS, wide: int = WIDE) -> DataFrame:
    """The same solve with the Gram matrix as a table, for any number of cells.

    A target of up to ``wide`` candidates is solved over all of them. One of more is solved over its ``wide`` strongest, then over
    its positive weights and the ``wide`` candidates that most want to enter, until none does: the optimum is the same, and
    no task ever holds all candidates squared. A task holds the square of a target's positive weights, though.
    """
    half = written(upper_half(x, integral), "gram")
    entries = mirrored(half)
    # the filter comes before the mirror; candidates are few beside all entries
    cand = written(candidates(mirrored(half.where((F.col("p") >= p.lambd) & (F.col("item") != F.col("neighbor")))), p.lambd), "candidate-entries")
    sizes = written(cand.groupBy("item").agg(F.count(F.lit(1)).alias("m")), "candidates")
    large = sizes.where(F.col("m") > wide).select("item")
    n_large = large.count()
    narrow = cand if not n_large else cand.join(large, "item", "left_anti")
    solved = written(_solve_within(narrow, half, p, block_cells), "solved")
    if n_large:
        broad = written(cand.join(large, "item", "left_semi"), "wide")
        found = written(_solve_within(_strongest(broad, "p", wide), half, p, block_cells), "wide-solved")
        for no in count():
            entering = written(_entering(found, broad, entries, p), "entering")
            if not p.max_iter or entering.isEmpty():
                break
            if no == WIDE_ROUNDS:  # stated as not converged, like a target that runs out of passes
                late = entering.select(F.col("item").alias("target"), F.lit(True).alias("_late")).distinct()
                found = written(found.join(late, "target", "left").withColumn("converged", F.col("converged") & F.col("_late").isNull()).drop("_late"), "wide-solved")
                break
            again = entering.select("item").distinct()
            z = found.select(F.col("target").alias("item"), F.explode("sources").alias("neighbor")).join(again, "item", "left_semi")
            held = broad.join(z, ["item", "neighbor"], "left_semi").select("item", "neighbor", "p")
            more = _strongest(entering, "step", wide).select("item", "neighbor", "p")
            renewed = _solve_within(held.unionByName(more), half, p, block_cells)
            rest = found.join(again.withColumnRenamed("item", "target"), "target", "left_anti")
            found = written(rest.unionByName(renewed), "wide-solved")
        solved = solved.unionByName(found)
    idle = universe.join(sizes, "item", "left_anti")
    return solved.unionByName(idle.selectExpr("item as target", *_EMPTY_COLUMNS))


def _coded(x: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``x`` with ascending bigints in place of the ids in ``column``, and the dictionary (id, code); no id is hashed."""
    book = numbered(x.select(column).distinct(), [column], "_code")
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = x.groupBy(column).count().where(F.col("count") > HOT_ROWS)
    others = [c for c in x.columns if c != column]
    coded = spread_join(x, book, [column], hot, others, parts)
    return coded.select(*(F.col("_code").alias(column) if c == column else F.col(c) for c in x.columns)), book


def _named(raw: DataFrame, book: DataFrame) -> DataFrame:
    """Solutions over codes with the items they stand for."""
    one = raw.join(book.select(F.col("_code").alias("target"), F.col("item").alias("_target")), "target")
    flat = one.select("_target", "n_passes", "converged", F.explode_outer(F.arrays_zip("sources", "weights")).alias("z"))
    flat = flat.withColumn("_code", F.col("z.sources")).join(book, "_code", "left")
    cell = F.when(F.col("item").isNotNull(), F.struct(F.col("item").alias("s"), F.col("z.weights").alias("w")))
    # a list is as long as the positive weights of one target, which a task of the solve has held
    lists = flat.groupBy(F.col("_target").alias("target")).agg(F.array_sort(F.collect_list(cell)).alias("c"), F.first("n_passes").alias("n_passes"), F.first("converged").alias("converged"))
    return lists.select("target", F.col("c.s").alias("sources"), F.col("c.w").alias("weights"), "n_passes", "converged")


def solve(interactions: DataFrame, params: SolverParams, items: DataFrame | None = None, strategy: str = "auto", block_cells: int = BLOCK_CELLS, wide: int = WIDE) -> Solution:
    """Weights and diagnostics for every item of the universe (``items``, or the items that occur).

    ``interactions`` is (user, item, value) in any state; it is checked and made canonical. ``strategy`` is 'broadcast'
    (matrix in each worker), 'blocked' (Gram matrix as a table) or 'auto': broadcast up to BROADCAST_CELLS
    cells, which is a checked size. Both give the same weights. Results do not depend on partitioning.
    """
    params = params.checked()
    if strategy not in ("auto", "broadcast", "blocked"):
        raise ValueError(f"strategy must be 'auto', 'broadcast' or 'blocked', got {strategy!r}")
    x, facts = settled(interactions)
    per_item = x.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("value")).alias("p"))
    totals = per_item.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.count(F.lit(1)).alias("items"), F.max("p").alias("p")).first()
    refuse_overflow(totals.p)
    n_items, universe = totals.items, None
    if items is not None:
        universe = written(item_universe(x, items), "universe")
        n_items = universe.count()
        stray = x.join(universe, "item", "left_anti").select("item").first()
        if stray is not None:
            raise ValueError(f"interactions hold item {stray.item}, which is not among the given items")
    if strategy == "auto":
        strategy = "broadcast" if totals.cells <= BROADCAST_CELLS and n_items <= BROADCAST_CELLS else "blocked"
    if strategy == "broadcast":
        raw = _solve_broadcast(x, universe, params)
    else:
        universe = item_universe(x) if universe is None else universe
        y, book = x, None
        if x.schema["item"].dataType != T.LongType():
            codes = universe.unionByName(x.select("item")).distinct()
            book = numbered(written(codes, "items"), ["item"], "_code")
            y, universe = x.join(book, "item").select("user", F.col("_code").alias("item"), "value"), universe.join(book, "item").select(F.col("_code").alias("item"))
        if x.schema["user"].dataType != T.LongType():
            y, _ = _coded(y, "user")
        raw = _solve_blocks(y if y is x else written(y, "coded"), universe, params, facts.integral, block_cells, wide)
        raw = raw if book is None else _named(raw, book)
    out = written(raw, "solution")
    weights = out.select(F.explode(F.arrays_zip("sources", "weights")).alias("z"), "target").select(F.col("z.sources").alias("source"), "target", F.col("z.weights").alias("weight"))
    diagnostics = out.select(F.col("target").alias("item"), "n_passes", "converged")
    totals = diagnostics.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("converged")).alias("bad")).first()
    return Solution(weights, diagnostics, totals.n, totals.bad)


def warn_unconverged(s: Solution, p: SolverParams, stacklevel: int) -> None:
    if s.n_unconverged:
        warnings.warn(
            f"{s.n_unconverged} of {s.n_items} items did not converge within max_iter={p.max_iter}: some weight could still move by "
            f"tol={p.tol} or more. Look up these items in the diagnostics; more passes or a larger beta help.",
            ConvergenceWarning,
            stacklevel=stacklevel,
        )


def fit_with_diagnostics(
    interactions: DataFrame,
    lambd: float = 0.5,
    beta: float = 0.5,
    max_iter: int = 1000,
    tol: float = 1e-4,
    n_threads: int | None = None,
    *,
    user_col: str = "user",
    item_col: str = "item",
    value_col: str | None = "value",
    items: DataFrame | None = None,
    strategy: str = "auto",
    _stacklevel: int = 3,
) -> Solution:
    """Like `fit`, with the passes and the convergence flag of each item."""
    params = SolverParams(lambd, beta, max_iter, tol, n_threads).checked()
    named = items.select(F.col(item_col).alias("item")) if items is not None and item_col in items.columns else items
    found = solve(as_interactions(interactions, user_col, item_col, value_col), params, named, strategy)
    warn_unconverged(found, params, _stacklevel)
    return found


def fit(
    interactions: DataFrame,
    lambd: float = 0.5,
    beta: float = 0.5,
    max_iter: int = 1000,
    tol: float = 1e-4,
    n_threads: int | None = None,
    *,
    user_col: str = "user",
    item_col: str = "item",
    value_col: str | None = "value",
    items: DataFrame | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Weights (source, target, weight > 0) of the non-negative elastic net of every item on all others.

    Runs jobs: values are checked (ValueError names the cell), the solve is written to the shared folder and a
    `ConvergenceWarning` tells how many items ran out of passes. ``items`` adds items that never occur.
    """
    return fit_with_diagnostics(
        interactions, lambd, beta, max_iter, tol, n_threads, user_col=user_col, item_col=item_col, value_col=value_col, items=items, strategy=strategy, _stacklevel=4
    ).weights


def optimality(x: DataFrame, weights: DataFrame, items: DataFrame, lambd: float, beta: float, integral: bool = True) -> DataFrame:
    """(target, violation): the largest optimality violation over all other items, in units of the gradient.

    The gradient of weight k of target i is P_ki - sum_j P_kj w_ji - lambd - beta w_ki; it has to be 0 for a positive
    weight and at most 0 otherwise. Pairs without entry in P or W have gradient -lambd and never violate.
    """
    p = written(gram(x, integral), "gram")
    fitted = (
        p.join(weights, F.col("neighbor") == F.col("source"))
        .groupBy(F.col("item").alias("k"), F.col("target").alias("i"))
        .agg(F.sum(F.col("p") * F.col("weight")).alias("fit"))
    )
    own = weights.select(F.col("source").alias("k"), F.col("target").alias("i"), F.col("weight").alias("w"))
    both = p.select(F.col("item").alias("k"), F.col("neighbor").alias("i"), "p").join(fitted, ["k", "i"], "full").join(own, ["k", "i"], "full").where(F.col("k") != F.col("i"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    gradient = zero("p") - zero("fit") - F.lit(lambd) - F.lit(beta) * zero("w")
    violation = F.when(zero("w") > 0, F.abs(gradient)).otherwise(F.greatest(gradient, F.lit(0.0)))
    worst = both.select("i", violation.alias("v")).groupBy(F.col("i").alias("item")).agg(F.max("v").alias("v"))
    return items.join(worst, "item", "left").select(F.col("item").alias("target"), F.coalesce("v", F.lit(0.0)).alias("violation"))


def objective(x: DataFrame, weights: DataFrame, items: DataFrame, lambd: float, beta: float, integral: bool = True) -> DataFrame:
    """(target, objective): half the squared error plus penalties of each item, from the Gram matrix alone."""
    p = written(gram(x, integral), "gram")
    half = p.where(F.col("item") == F.col("neighbor")).select(F.col("item").alias("target"), (F.col("p") / 2).alias("part"))
    w = weights.select("source", "target", "weight")
    linear = w.join(p, (F.col("source") == F.col("item")) & (F.col("target") == F.col("neighbor"))).select("target", (-F.col("weight") * F.col("p")).alias("part"))
    left = w.select(F.col("source").alias("j"), "target", F.col("weight").alias("wj"))
    pairs = w.join(left, "target").join(p, (F.col("source") == F.col("item")) & (F.col("j") == F.col("neighbor")))
    quadratic = pairs.select("target", (F.col("weight") * F.col("wj") * F.col("p") / 2).alias("part"))
    penalty = w.select("target", (F.lit(lambd) * F.col("weight") + F.lit(beta) / 2 * F.col("weight") * F.col("weight")).alias("part"))
    parts = half.unionByName(linear).unionByName(quadratic).unionByName(penalty)
    total = parts.groupBy("target").agg(F.sum("part").alias("objective"))
    return items.select(F.col("item").alias("target")).join(total, "target", "left").select("target", F.coalesce("objective", F.lit(0.0)).alias("objective"))
