"""Per-key results when a few keys hold most rows: exact offset chunking.

1. Rows stay in the input partitions they lie in; each partition sorts its own by key and writes them once, numbered.
2. Rows are counted per (key, input partition), which the sorted partitions do before anything is shuffled; a running sum over
   these counts gives every (key, partition) its exact offset, so every row has an exact position in the order of keys.
3. Positions are cut into chunks of equal size: a key of a third of all rows just fills many chunks, and thousands of
   small keys share one. Results that can be put together from parts are aggregated by (chunk, key) on the map
   side, where rows lie; a step that needs all rows of a chunk gets them in one task (`apply_chunks`), equal work for each.
4. A key inside one chunk is finished there. Keys that cross a chunk border leave one state per chunk, merged in
   order of chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small
from ..functions.shared import written
from ..functions.sums import running_offsets


#: Most (key, partition) rows that are broadcast.
SMALL = 100_000


@dataclass(frozen=True)
class ChunkState:
    """One output column: ``partial`` aggregates the rows of a key in a chunk, ``merge`` the states of its chunks.

    ``merge`` gets the state column and the chunk number, so that it can depend on order; ``alone`` finishes the only
    state of a key.
    """

    name: str
    partial: Column
    merge: Callable[[Column, Column], Column]
    alone: Callable[[Column], Column] = lambda s: s


def count_state(name: str, where: Column | None = None) -> ChunkState:
    return ChunkState(name, F.count(F.lit(1)) if where is None else F.count_if(where), lambda s, c: F.sum(s))


def sum_state(name: str, column: Column) -> ChunkState:
    return ChunkState(name, F.sum(column), lambda s, c: F.sum(s))


def min_state(name: str, column: Column) -> ChunkState:
    return ChunkState(name, F.min(column), lambda s, c: F.min(s))


def max_state(name: str, column: Column) -> ChunkState:
    return ChunkState(name, F.max(column), lambda s, c: F.max(s))


def first_state(name: str, column: Column) -> ChunkState:
    """Value of the key's first row in the order of positions; a null value of that row is kept."""
    return ChunkState(name, F.min_by(F.struct(column.alias("v")), F.col("_pos")), lambda s, c: F.min_by(s, c)["v"], lambda s: s["v"])


def last_state(name: str, column: Column) -> ChunkState:
    """Value of the key's last row in the order of positions; a null value of that row is kept."""
    return ChunkState(name, F.max_by(F.struct(column.alias("v")), F.col("_pos")), lambda s, c: F.max_by(s, c)["v"], lambda s: s["v"])


@dataclass(frozen=True)
class Chunked:
    """``rows``: the input plus ``_pos`` (0, 1, ... over all rows, keys together), ``_chunk``, ``_start`` and ``_n`` (first position and rows of the key).

    ``marked``: the input with ``_chunk`` for the rows of keys that cross a chunk border and null for all others, and ``_pos`` that orders the
    rows of a key in the same way. It costs neither a shuffle nor a large broadcast.
    """

    rows: DataFrame
    key: str
    n_rows: int
    chunk_rows: int
    marked: DataFrame


def chunk_by_key(df: DataFrame, key: str, identity: list[str], chunk_rows: int | None = None) -> Chunked:
    """Exact positions and equal-sized chunks for all rows of ``df`` whose ``key`` is not null.

    The rows of a key are ordered by input partition and there by ``identity``. Rows are written to the shared folder
    once, numbered as they lie, so later passes and retries see the same numbers; only counts are shuffled.
    ``chunk_rows`` is by default the share of a quarter of a task. Totals do not depend on how the input is partitioned; positions,
    and with them first and last states, follow it.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clash = [c for c in df.columns if c in ("_part", "_at", "_pos", "_chunk", "_start", "_n", "_here", "_first", "_offset")]
    if clash:
        raise ValueError(f"columns {clash} are used by the operator itself; rename them")
    placed = df.where(F.col(key).isNotNull()).sortWithinPartitions(key, *identity).withColumn("_at", F.monotonically_increasing_id())
    numbered = written(placed, "numbered").withColumn("_part", F.shiftright("_at", 33))  # the upper bits are the input partition
    counts = written(numbered.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_here"), F.min("_at").alias("_first")), "counts")
    facts = counts.agg(F.coalesce(F.sum("_here"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("m")).first()
    size = chunk_rows or max(1, -(-facts.n // (4 * parts)))
    offsets = running_offsets(counts, [key, "_part"], "_here", "_offset")
    whole = Window.partitionBy(key)
    # what is added to a row's number to give its position
    shift = (F.col("_offset") - F.col("_first")).alias("_offset")
    offsets = written(offsets.select(key, "_part", shift, F.min("_offset").over(whole).alias("_start"), F.sum("_here").over(whole).alias("_n")), "offsets")
    chunk = F.expr(f"_pos div {size}")
    rows = numbered.join(broadcast_if_small(offsets, facts.m, SMALL), [key, "_part"]).withColumn("_pos", F.col("_at") + F.col("_offset"))
    rows = rows.withColumn("_chunk", chunk).drop("_part", "_at", "_offset")
    # a key crosses a border in each chunk but the last at most once
    border = offsets.where(F.expr(f"_start div {size} < (_start + _n - 1) div {size}")).select(key, "_part", "_offset")
    marked = numbered.join(broadcast_if_small(border, border.count(), SMALL), [key, "_part"], "left").withColumn("_pos", F.col("_at") + F.col("_offset"))
    marked = marked.withColumn("_chunk", chunk).withColumn("_pos", F.col("_at")).drop("_part", "_at", "_offset")
    return Chunked(rows, key, facts.n, size, marked)


def apply_chunks(chunked: Chunked, step: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``step`` of the rows of every chunk, in order of positions: each call has ``chunk_rows`` rows (the last one fewer), whatever the keys are.

    For per-key work that cannot be put together from small states on the map side; this shuffles the rows. ``step`` returns its states
    with the chunk, to be merged in that order.
    """
    return chunked.rows.groupBy("_chunk").applyInArrow(lambda t: step(t.sort_by("_pos")), schema)


def aggregate_chunks(chunked: Chunked, states: list[ChunkState]) -> DataFrame:
    """(key, one column per state) for every key of ``chunked``."""
    key = chunked.key
    # partial aggregation on the map side: at most one row per key and task, and one per chunk a border key fills, is shuffled
    parts = chunked.marked.groupBy("_chunk", key).agg(*(s.partial.alias(s.name) for s in states))
    parts = written(parts, "states")
    # keys inside one chunk are finished; a border key has one state per chunk it fills
    inside = F.col("_chunk").isNull()
    done = parts.where(inside).select(key, *(s.alone(F.col(s.name)).alias(s.name) for s in states))
    border = parts.where(~inside).groupBy(key).agg(*(s.merge(F.col(s.name), F.col("_chunk")).alias(s.name) for s in states))
    return done.unionByName(border)


def totals_by_key(df: DataFrame, key: str, identity: list[str], states: list[ChunkState], chunk_rows: int | None = None) -> DataFrame:
    """Per-key results of ``states`` by exact offset chunking.

    Null keys are left out, an empty table gives an empty result, repeated rows count as often as they occur,
    and other columns of ``df`` are ignored unless a state uses them.
    """
    return aggregate_chunks(chunk_by_key(df, key, identity, chunk_rows), states)


def heavy_keys(df: DataFrame, key: str, identity: list[str], one_in: int) -> DataFrame:
    """(key, n) of the keys that hold at least one in ``one_in`` of all rows with a key."""
    chunked = chunk_by_key(df, key, identity)
    counts = aggregate_chunks(chunked, [count_state("n")])
    return counts.where(F.col("n") * one_in >= F.lit(chunked.n_rows))
