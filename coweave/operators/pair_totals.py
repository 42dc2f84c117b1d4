"""Totals over all pairs of elements that share groups, by the number of groups they share.

`copairs.pair_products` makes a row for every pair, and its sums need all of them shuffled. Where only totals are wanted
and a few groups hold nearly every element, nearly all pairs occur, so they are formed and added up in the task that
meets them: elements are numbered by id and cut into chunks, each two bands of chunks go to one task, and a product of
two dense matrices gives the groups and the sum of each pair. What leaves a task is one row per number of groups.
Pairs are formed one by one, every one of them; none is estimated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small
from ..functions.shared import written
from ..functions.sums import numbered
from .copairs import group_sizes, pair_products

#: Elements of one chunk, and the rows of it that are multiplied at once.
CHUNK, ROWS = 2048, 64
#: Chunks of one band: two bands of 25 groups are 6 MB, of `MOST_GROUPS` 60 MB.
BAND = 16
MOST_GROUPS = 256
#: Most cells of a histogram of (sum, groups), which is faster than totals per number of groups.
MOST_CELLS = 1 << 17
#: Sums and groups are told apart in one float; 32 and 64 bits hold whole numbers up to these.
SINGLE, DOUBLE = 1 << 24, 1 << 53
#: So many pairs of weights below 256 are counted and added up in one double.
PACKED, SHIFT = 1 << 22, 2.0**30
#: A product in a row of its own costs at least this many times a pair in a dense matrix.
ROW_COST = 32

Weight = Callable[[np.ndarray, np.ndarray], np.ndarray]
_SCHEMA = "n bigint, pairs bigint, total double, weighted double"


def _batch(n: np.ndarray, pairs: np.ndarray, total: np.ndarray, weighted: np.ndarray) -> pa.RecordBatch:
    kept = (n > 0) & (pairs > 0)
    columns = (n.astype(np.int64), pairs.astype(np.int64), total.astype(np.float64), weighted.astype(np.float64))
    return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], names=["n", "pairs", "total", "weighted"])


def _chunks(rows: DataFrame, elements: DataFrame, n_elements: int, groups: list[int], cell: str, chunk: int) -> DataFrame:
    """(chunk, ids, cells): per chunk its ids ascending and a matrix (ids, groups) of values, -1 where a group does not hold an element; as bytes."""
    book = numbered(elements.select("e"), ["e"], "code")
    coded = rows.join(broadcast_if_small(book, n_elements), "e")
    order = np.array(groups, dtype=np.int64)

    def pack(table: pa.Table) -> pa.Table:
        at = table["code"].to_numpy() % chunk
        ids = np.zeros(at.max() + 1, dtype=np.int64)  # codes have no gaps
        cells = np.full((len(ids), len(order)), -1, dtype=cell)
        ids[at] = table["e"].to_numpy()
        cells[at, np.searchsorted(order, table["g"].to_numpy())] = table["v"].to_numpy()
        return pa.table({"chunk": table["chunk"][:1], "ids": [ids.tobytes()], "cells": [cells.tobytes()]})

    chunks = coded.withColumn("chunk", F.expr(f"code div {chunk}")).groupBy("chunk")
    return written(chunks.applyInArrow(pack, "chunk bigint, ids binary, cells binary"), "chunks")


def _dense(chunks: DataFrame, n_chunks: int, n_groups: int, most: int, cell: str, weight: Weight, band: int) -> DataFrame:
    bands = ceil(n_chunks / band)
    own = F.expr(f"chunk div {band}")
    sides = chunks.select("*", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("other"))
    low, high = F.least(own, "other"), F.greatest(own, "other")
    # one partition per two bands
    sides = sides.select((high * (high + 1) / 2 + low).cast("int").alias("task"), "chunk", "ids", "cells").repartitionById(bands * (bands + 1) // 2, "task")
    bits = n_groups.bit_length()
    mask = (1 << bits) - 1
    kind = np.float32 if most <= SINGLE else np.float64
    joint = most <= MOST_CELLS
    cells = most if joint else mask + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {}
        for batch in batches:
            for at, ids, values in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                parts[at] = np.frombuffer(ids, dtype=np.int64), np.frombuffer(values, dtype=cell).reshape(-1, n_groups)
        if not parts:
            return
        first, last = min(parts) // band, max(parts) // band
        pairs, totals, weighted = np.zeros(cells, dtype=np.int64), np.zeros(cells), np.zeros(cells)
        below = np.tril_indices(ROWS)
        for two in (c for c in parts if c // band == last):
            b, v = parts[two]
            # one product: the groups that hold both in the lower bits, the sum of products of values above
            right = np.ascontiguousarray(np.hstack([v >= 0, np.maximum(v, 0)]).T, dtype=kind)
            for one in (c for c in parts if c // band == first and c <= two):
                a, u = parts[one]
                both = np.zeros(cells)
                left = np.hstack([u >= 0, np.maximum(u, 0).astype(np.int64) << bits]).astype(kind)
                for lo in range(0, len(a), ROWS):
                    start = lo if one == two else 0
                    key = (left[lo : lo + ROWS] @ right[:, start:]).astype(np.int64)
                    if one == two:  # each two elements once, none with itself: what has no group does not count
                        r, c = below
                        inside = (r < key.shape[0]) & (c < key.shape[1])
                        key[r[inside], c[inside]] = 0
                    w = weight(a[lo : lo + ROWS, None], b[None, start:])
                    if joint:
                        at = key.ravel()
                        if w.dtype == np.uint8 and len(a) * len(b) <= PACKED:  # pairs in the upper bits of a double, weights in the lower ones
                            both += np.bincount(at, (w + SHIFT).ravel(), cells)
                            continue
                    else:
                        at, sums = (key & mask).ravel(), (key >> bits).astype(np.float64)
                        totals += np.bincount(at, sums.ravel(), cells)
                        w = w * sums
                    pairs += np.bincount(at, minlength=cells)
                    weighted += np.bincount(at, w.ravel(), cells)
                upper = np.floor(both / SHIFT)
                pairs += upper.astype(np.int64)
                weighted += both - upper * SHIFT
        n = np.arange(cells)
        if joint:
            n, sums = n & mask, n >> bits
            pairs, totals, weighted = (np.bincount(n, x, mask + 1) for x in (pairs, pairs * sums, weighted * sums))
            n = np.arange(mask + 1)
        yield _batch(n, pairs, totals, weighted)

    return sides.mapInArrow(run, _SCHEMA)


def _of_pairs(pairs: DataFrame, weight: Weight) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, s, n = (batch.column(k).to_numpy() for k in range(4))
            kinds, at = np.unique(n, return_inverse=True)
            yield _batch(kinds, np.bincount(at), np.bincount(at, s), np.bincount(at, s * weight(a, b)))

    return pairs.select("a", "b", "s", "n").mapInArrow(run, _SCHEMA)


def totals_by_shared(rows: DataFrame, group: str, element: str, value: str, weight: Weight, *, chunk: int = CHUNK, band: int = BAND) -> DataFrame:
    """(n, pairs, total, weighted) per number n > 0 of groups that two elements a < b share: the pairs, the sum of s, the products of values over shared groups, and the sum of s * weight(a, b).

    ``rows`` holds each (group, element) once and is read several times; rows without group or element are left out. ``weight`` takes arrays of ids that may
    have to be broadcast against each other; weights of type uint8 are added up fastest. Totals are exact where values and weights are whole numbers and the totals
    below 2**53. At most 256 groups that together hold much of all pairs, with whole values that are not negative, take the dense way;
    all else takes `pair_products`. Empty input gives an empty result.
    """
    rows = rows.select(F.col(group).cast("bigint").alias("g"), F.col(element).cast("bigint").alias("e"), F.col(value).cast("double").alias("v")).dropna(subset=["g", "e"])
    elements = written(rows.groupBy("e").agg(F.sum(F.col("v") * F.col("v")).alias("square"), F.min(F.coalesce((F.col("v") >= 0) & (F.col("v") == F.floor("v")), F.lit(False))).alias("plain")), "elements")
    n, square, plain = elements.agg(F.count(F.lit(1)), F.max("square"), F.min("plain")).first()
    sizes = written(group_sizes(rows, "g"), "sizes")
    n_groups, products = sizes.agg(F.count(F.lit(1)), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    # no sum of products is above the largest square
    most = (int(square) + 1) << n_groups.bit_length() if n and plain and square < DOUBLE else 0
    if 0 < most <= DOUBLE and n_groups <= MOST_GROUPS and float(n) * n * (1 + n_groups / 64) <= ROW_COST * products:
        n_chunks = ceil(n / chunk)
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        # as many bands as give each partition three tasks, but not more of them than chunks
        wide = max(1, min(band, int(n_chunks / sqrt(6 * parts))))
        cell = "int16" if square < 1 << 30 else "int32"
        chunks = _chunks(rows, elements, n, sorted(r["g"] for r in sizes.select("g").collect()), cell, chunk)
        found = _dense(chunks, n_chunks, n_groups, most, cell, weight, wide)
    else:
        found = _of_pairs(pair_products(rows, "g", "e", "v"), weight)
    return found.groupBy("n").agg(*(F.sum(c).alias(c) for c in ("pairs", "total", "weighted")))
