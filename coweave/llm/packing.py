"""Filling containers of fixed capacity with documents: packing per partition, certified by lower bounds, and repacked.

Each partition packs its documents best-fit decreasing and compares its number of containers with a lower bound from
dual-feasible functions: no packing of these documents needs fewer. Partitions that meet the bound keep their containers
but for those less than half full; the others keep only full ones. The documents of the rest are exchanged: they form a
pool that is dealt out again and packed anew, until the total meets the bound of the whole or a round saves nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written
from ..functions.sums import numbered
from .encode import count_tokens

CAPACITY = 2048
#: Pieces that one partition packs, on average.
PARTITION_PIECES = 25_000


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Fewest containers that ``counts`` pieces of ``sizes`` (1..capacity) can need, by two families of dual-feasible functions.

    A dual-feasible function maps sizes to weights such that pieces that fit a container together weigh 1 at most; then the
    total weight, rounded up, is a bound. Used here: sizes above capacity - t count as whole and those below t as nothing,
    for every t up to half the capacity; and the rounding functions with k = 1..30.
    """
    if not len(sizes):
        return 0
    x = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(x, sizes, counts)
    amount = np.arange(capacity + 1) * x
    number_from = np.cumsum(x[::-1])[::-1]  # pieces of at least this size
    amount_from = np.cumsum(amount[::-1])[::-1]
    t = np.arange(1, capacity // 2 + 1)
    whole = number_from[capacity - t + 1]
    between = amount_from[t] - amount_from[capacity - t + 1]
    best = int((whole + -(-between // capacity)).max())
    best = max(best, -(-int(amount.sum()) // capacity))
    at = np.flatnonzero(x)
    for k in range(1, 31):
        scaled = (k + 1) * at
        exact = scaled % capacity == 0
        weight = np.where(exact, at * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((weight * x[at]).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each piece, filling of each container). Pieces are taken by size, largest first, the earlier one first among equals.

    Each goes to the fullest container that has room. Containers wait by free room; one bit per room tells which rooms
    occur, so the best one is the lowest bit from the size up: constant time per piece for a given capacity.
    """
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, filled = 0, []
    for k in order.tolist():
        size = int(sizes[k])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(filled)
            filled.append(0)
        bins[k] = b
        filled[b] += size
        left = room - size
        if left:
            waiting[left].append(b)
            rooms |= 1 << left
    return bins, np.array(filled, dtype=np.int64)


@dataclass(frozen=True)
class Packing:
    """``pieces``: (doc_id, piece, container, tok_start, tok_stop), written; and the totals that certify it."""

    pieces: DataFrame
    containers: int
    bound: int
    tokens: int
    rounds: int


_PACKED = "row bigint, doc_id {0}, piece bigint, tok_start bigint, size bigint, bin bigint, filled bigint, part int, bound bigint"


def _pack(items: DataFrame, parts: int, salt: int, capacity: int) -> DataFrame:
    """Packs (row, doc_id, n_tokens, tok_start, piece) in ``parts`` partitions by hash; a text beyond the capacity is cut here."""
    kind = items.schema["doc_id"].dataType.simpleString()
    dealt = items.withColumn("part", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("row", "ascending"), ("tok_start", "ascending")])
        n = t.column("n_tokens").to_numpy()
        start, piece, row = (t.column(c).to_numpy() for c in ("tok_start", "piece", "row"))
        full, rest = n // capacity, n % capacity
        # full containers: one piece each
        many = np.repeat(np.arange(len(n)), full)
        nth = np.arange(len(many)) - np.repeat(np.cumsum(full) - full, full)
        some = np.flatnonzero(rest)
        bins, filled = best_fit_decreasing(rest[some], capacity)
        sizes, counts = np.unique(rest[some], return_counts=True)
        bound = lower_bound(sizes, counts, capacity) + len(many)
        at = np.r_[some, many]
        out = {
            "row": row[at],
            "piece": np.r_[piece[some] + full[some], piece[many] + nth],
            "tok_start": np.r_[start[some] + full[some] * capacity, start[many] + nth * capacity],
            "size": np.r_[rest[some], np.full(len(many), capacity)],
            "bin": np.r_[bins, len(filled) + np.arange(len(many))],
            "filled": np.r_[filled[bins] if len(bins) else bins, np.full(len(many), capacity)],
        }
        cols = {k: pa.array(v.astype(np.int64)) for k, v in out.items()}
        names = t.column("doc_id").take(pa.array(at))
        part = pa.array(np.full(len(at), t.column("part")[0].as_py(), np.int32))
        return pa.table({"row": cols["row"], "doc_id": names, "piece": cols["piece"], "tok_start": cols["tok_start"], "size": cols["size"], "bin": cols["bin"], "filled": cols["filled"], "part": part, "bound": pa.array(np.full(len(at), bound))})

    return dealt.groupBy("part").applyInArrow(run, _PACKED.format(kind))


def _parts(n: int, size: int) -> int:
    return max(1, -(-n // size))


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int | None = None) -> Packing:
    """Lays items of ``size`` into containers of ``capacity``.

    An item is divided only if it alone exceeds the capacity: into full containers and one rest. Items of size 0 or null
    take no room; they have one piece from 0 to 0 with a null container. Every row is its own item, repeated keys
    included; other columns are ignored; an empty table gives no containers. The packing depends on keys and sizes alone, not on
    files or partitions; rows equal in both are interchangeable. ``rounds`` limits the repackings; by default they go on
    until the bound is met or a round saves nothing.
    """
    if capacity < 1:
        raise ValueError(f"capacity must be >= 1, got {capacity}")
    spark = sizes.sparkSession
    rows = sizes.select(F.col(key).alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n_tokens"))
    # numbers follow key and size, so containers do not depend on how the input lies in files
    rows = numbered(written(rows, "sizes"), ["doc_id", "n_tokens"], "row")
    facts = rows.agg(F.count_if(F.col("n_tokens") > 0).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    # at most `capacity` sizes of rests
    rests = rows.select(F.pmod("n_tokens", F.lit(capacity)).alias("s"), F.expr(f"n_tokens div {capacity}").alias("f")).groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.sum("f").alias("f")).collect()
    some = [r for r in rests if r.s]
    bound = lower_bound(np.array([r.s for r in some], dtype=np.int64), np.array([r.m for r in some], dtype=np.int64), capacity) + sum(r.f for r in rests)

    columns = ["row", "doc_id", "piece", "tok_start", "size"]
    done: list[DataFrame] = []
    containers, used, best = 0, 0, None
    start = F.lit(0).cast("bigint")
    todo = rows.where(F.col("n_tokens") > 0).select("row", "doc_id", "n_tokens", start.alias("tok_start"), start.alias("piece"))
    n = facts.n

    def identified(packed: DataFrame, no: int) -> DataFrame:
        """Container numbers that no other round, partition or bin has."""
        number = F.shiftleft(F.lit(no).cast("bigint"), 52).bitwiseOR(F.shiftleft(F.col("part").cast("bigint"), 30)).bitwiseOR(F.col("bin"))
        return packed.select(*columns, number.alias("container"))

    def counted(packed: DataFrame) -> int:
        per = packed.groupBy("part").agg((F.max("bin") + 1).alias("bins"))
        return per.agg(F.sum("bins").alias("bins")).first().bins

    for no in count():
        if not n:
            break
        packed = written(_pack(todo, _parts(n, partition_pieces), no, capacity), f"packed-{no}")
        total = counted(packed)
        if best is not None and total >= best[1]:
            break  # no better than before: the pool stays as it was packed
        used = no + 1
        gap = packed.groupBy("part").agg((F.max("bin") + 1 > F.first("bound")).alias("open"))
        marked = packed.join(gap, "part")
        is_open = (F.col("open") & (F.col("filled") < capacity)) | (F.col("filled") * 2 < capacity)
        pool = marked.where(is_open)
        facts_open = pool.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part", "bin").alias("bins")).first()
        done.append(identified(marked.where(~is_open), no))
        containers += total - facts_open.bins
        best = (identified(pool, no), facts_open.bins)
        if facts_open.bins < 2 or no == rounds or containers + facts_open.bins <= bound:
            break
        n = facts_open.n
        todo = pool.select("row", "doc_id", F.col("size").alias("n_tokens"), "tok_start", "piece")
    if best is not None:
        containers += best[1]
        done.append(best[0])
    empty = rows.where(F.col("n_tokens") == 0).select("row", "doc_id", start.alias("piece"), start.alias("tok_start"), start.alias("size"), F.lit(None).cast("bigint").alias("container"))
    everything = empty
    for frame in done:
        everything = everything.unionByName(frame)
    pieces = everything.select("doc_id", "piece", "container", "tok_start", (F.col("tok_start") + F.col("size")).alias("tok_stop"))
    return Packing(pieces.withColumnRenamed("doc_id", key), containers, bound, facts.tokens, used)


def pack_documents(documents: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, path: str | None = None, **kwargs: int) -> Packing:
    """`pack` of texts by their number of tokens; null and empty texts have none."""
    return pack(count_tokens(documents, text, (key,), path), key, "n_tokens", capacity, **kwargs)
