"""Pairs of elements that share groups: counts or weighted products over all pairs, without hot groups.

Rows say that a group (user, basket, identifier) holds an element (item, set). For every two elements the operator
counts the groups that hold both, or sums the products of their values.

Groups of at most ``max_group`` elements are joined with themselves and reduced before the shuffle (map-side
aggregation), so their pairs are never stored. Larger groups would emit the square of their size. Their elements are
numbered from the most to the least frequent one and cut into blocks; a group sends each two of its blocks to a tile, where a
dense array adds up all groups of the tile before anything is sent on. A tile that is met by many groups is divided
among tasks by group. Two blocks in which a group has only a few members are joined like small groups: a dense array
would gain nothing. All of it is added up in one aggregation, is exact, and covers every group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import BROADCAST_ROWS, broadcast_if_small, spread_join
from ..functions.shared import written
from ..functions.sums import Limbs, exact_sum, limbs, numbered, ordered_sum

MAX_GROUP = 256
#: Elements of one side of a tile: its two dense arrays are 64 MB at most.
BLOCK = 2048
#: Products that one task adds up in a tile; a tile of more is divided by group.
TILE_WORK = 100_000_000
#: Products of a group in a tile from which the dense array is worth its while.
DENSE_FROM = 64


def group_sizes(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def _join_pairs(rows: DataFrame, diagonal: bool) -> DataFrame:
    a = rows.select(F.col("g"), F.col("e").alias("a"), F.col("v").alias("va"))
    b = rows.select(F.col("g"), F.col("e").alias("b"), F.col("v").alias("vb"))
    return a.join(b, "g").where(F.col("a") <= F.col("b") if diagonal else F.col("a") < F.col("b"))


def _tiled(rows: DataFrame, parts: int, block: int, work: int) -> DataFrame:
    """(t1, t2, products, salt, g, x, y): for every group of ``rows`` (g, e, v) each two of its blocks t1 <= t2, with the members (at, e, v) of both; y is null where t1 = t2.

    A list holds the members of one group in one block, ``block`` at most.
    """
    elements = written(rows.groupBy("e").agg(F.count(F.lit(1)).alias("m")), "elements")
    book = numbered(elements.withColumn("_rare", -F.col("m")), ["_rare", "e"], "code").select("e", "code", "m")
    n = book.count()
    if n <= BROADCAST_ROWS:
        coded = rows.join(F.broadcast(book.select("e", "code")), "e")
    else:
        coded = spread_join(rows, book.select("e", "code"), ["e"], book.where(F.col("m") > 100_000), ["g"], parts)
    member = F.struct((F.col("code") % block).cast("int").alias("at"), "e", "v")
    lists = written(coded.groupBy("g", F.expr(f"code div {block}").alias("t")).agg(F.array_sort(F.collect_list(member)).alias("x")), "blocks")
    left = lists.select("g", F.col("t").alias("t1"), "x")
    right = lists.select("g", F.col("t").alias("t2"), F.col("x").alias("y"))
    pairs = left.join(right, "g").where("t1 <= t2").withColumn("y", F.when(F.col("t1") < F.col("t2"), F.col("y")))
    products = F.size("x").cast("bigint") * F.coalesce(F.size("y"), F.size("x"))
    pairs = pairs.withColumn("products", products)
    # a tile's share of tasks follows from its counted products
    tiles = written(pairs.groupBy("t1", "t2").agg((F.expr("sum(products)") / work).cast("int").alias("more")).where("more > 0"), "tiles")
    salt = F.pmod(F.xxhash64("g"), F.coalesce(F.col("more"), F.lit(0)) + 1)
    return pairs.join(broadcast_if_small(tiles, tiles.count()), ["t1", "t2"], "left").select("t1", "t2", "products", salt.cast("int").alias("salt"), "g", "x", "y")


def _tile_pairs(rows: DataFrame, parts: int, diagonal: bool, block: int, work: int) -> DataFrame:
    """(a, b, s, n) over the groups in ``rows``: one row for each pair, tile and share of a tile that has met the pair, and one for each product outside dense tiles."""
    tiled = _tiled(rows, parts, block, work)
    few = tiled.where(F.col("products") < DENSE_FROM).select("t1", "t2", F.explode("x").alias("p"), F.coalesce("y", "x").alias("y")).select("t1", "t2", "p", F.explode("y").alias("q"))
    once = (F.col("t1") < F.col("t2")) | (F.col("p.e") <= F.col("q.e") if diagonal else F.col("p.e") < F.col("q.e"))
    few = few.where(once).select(F.least("p.e", "q.e").alias("a"), F.greatest("p.e", "q.e").alias("b"), (F.col("p.v") * F.col("q.v")).alias("s"), F.lit(1).cast("bigint").alias("n"))
    columns = ("t1", "t2", "salt", "g", "x", "y")
    tiled = tiled.where(F.col("products") >= DENSE_FROM).select(*columns).repartition(parts, "t1", "t2", "salt").sortWithinPartitions("t1", "t2", "salt", "g")

    def members(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of the lists, and the places, elements and values of all members."""
        flat = column.flatten()
        sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
        return np.r_[0, np.cumsum(sizes)], *(f.to_numpy(zero_copy_only=False) for f in flat.flatten())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int, int] | None = None
        total, shared = np.zeros((block, block)), np.zeros((block, block), dtype=np.int64)
        names = np.zeros((2, block), dtype=np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            same = key[0] == key[1]
            i, j = np.nonzero(shared)
            if same and not diagonal:
                i, j = i[i < j], j[i < j]
            elif same:
                i, j = i[i <= j], j[i <= j]
            one, two = names[0][i], names[0 if same else 1][j]
            a, b = np.minimum(one, two), np.maximum(one, two)
            for lo in range(0, len(a), 65536):
                cut = slice(lo, lo + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a[cut], b[cut], total[i[cut], j[cut]], shared[i[cut], j[cut]])], names=["a", "b", "s", "n"])
            total[:], shared[:] = 0, 0

        for batch in batches:
            t1, t2, salt = (batch.column(k).to_numpy() for k in range(3))
            xs, ys = members(batch.column(4)), members(batch.column(5))
            for r in range(batch.num_rows):
                here = (int(t1[r]), int(t2[r]), int(salt[r]))
                if here != key:
                    yield from flush()
                    key = here
                x = slice(xs[0][r], xs[0][r + 1])
                own = xs if key[0] == key[1] else ys
                y = slice(own[0][r], own[0][r + 1])
                names[0][xs[1][x]], names[1][own[1][y]] = xs[2][x], own[2][y]
                at = np.ix_(xs[1][x], own[1][y])
                total[at] += np.outer(xs[3][x], own[3][y])
                shared[at] += 1
        yield from flush()

    return few.unionByName(tiled.mapInArrow(run, "a bigint, b bigint, s double, n bigint"))


def _layout(rows: DataFrame) -> Limbs | None:
    """Limbs for sums of products of values in ``rows``."""
    size = F.when(F.col("v") != 0, F.abs(F.col("v")))
    found = rows.agg(F.max(size).alias("hi"), F.min(size).alias("lo"), F.count(F.lit(1)).alias("n")).first()
    # a tile adds up in the order of groups; its sum counts as that many terms
    return limbs((found.hi or 0.0) ** 2, (found.lo or 0.0) ** 2, found.n)


def pair_products(
    rows: DataFrame,
    group: str,
    element: str,
    value: str | None = None,
    *,
    diagonal: bool = False,
    integral: bool = True,
    min_count: int = 1,
    max_group: int = MAX_GROUP,
    block: int = BLOCK,
    work: int = TILE_WORK,
) -> DataFrame:
    """(a, b, s, n) for all a < b (a <= b with ``diagonal``) that share at least ``min_count`` groups: s the sum of value products, n the shared groups.

    ``rows`` holds each (group, element) once, both bigint and not null; ``value=None`` counts 1 for each. With
    ``integral=False`` products are added up without rounding, so sums do not depend on partitioning. Empty input
    gives an empty result; other columns of ``rows`` are ignored.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(element).alias("e"), (F.col(value).cast("double") if value else F.lit(1.0)).alias("v"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    large = written(group_sizes(rows, "g").where(F.col("n") > max_group).select("g"), "large-groups")
    n_large = large.count()
    large = broadcast_if_small(large, n_large)
    light = rows if not n_large else rows.join(large, "g", "left_anti")
    pairs = _join_pairs(light, diagonal).select("a", "b", (F.col("va") * F.col("vb")).alias("s"), F.lit(1).cast("bigint").alias("n"))
    if n_large:
        pairs = pairs.unionByName(_tile_pairs(rows.join(large, "g", "left_semi"), parts, diagonal, block, work))
    shared = F.sum("n").alias("n")
    if value is None:  # one sum serves both
        out = pairs.groupBy("a", "b").agg(shared).select("a", "b", F.col("n").cast("double").alias("s"), "n")
    elif integral:
        out = pairs.groupBy("a", "b").agg(F.sum("s").alias("s"), shared)
    else:
        out = _fractional(pairs, rows, shared)
    return out.where(F.col("n") >= min_count)


def _fractional(pairs: DataFrame, rows: DataFrame, shared: Column) -> DataFrame:
    layout = _layout(rows)
    if layout is not None:
        return exact_sum(pairs, ["a", "b"], F.col("s"), layout, "s", shared).select("a", "b", "s", "n")
    kept = written(pairs, "products")
    return ordered_sum(kept, ["a", "b"], F.col("s"), F.col("s"), "s").join(kept.groupBy("a", "b").agg(shared), ["a", "b"])
