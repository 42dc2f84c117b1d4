"""Top N items within every group by one global sort, whatever the sizes of groups.

Rows are range-partitioned and sorted by (group, score descending, item). A large group then spans several partitions and
a partition holds many small groups. Each partition numbers its rows within their group and keeps at most N per group,
together with the number of rows it has of its first and last group; those counts, prefix-summed over partitions, turn
local numbers into exact positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import written
from ..operators.interactions import is_finite


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, *, positive: bool = False) -> DataFrame:
    """(group, item, score, position from 1): the ``n`` items of greatest score of each group, smaller item first among equals.

    An item that is repeated in a group counts once, with its greatest score. Rows with a null group or item, or a
    score that is null, NaN or infinite (with ``positive`` also zero or negative), do not count; other columns are
    ignored. Groups of fewer items give fewer rows; an empty table gives none.
    """
    if n < 1:
        raise ValueError(f"n must be >= 1, got {n}")
    spark = df.sparkSession
    value = F.col(score).cast("double")
    clean = df.select(F.col(group).alias("g"), F.col(item).alias("i"), value.alias("v")).where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("v").isNotNull() & is_finite(F.col("v")))
    if positive:
        clean = clean.where(F.col("v") > 0)
    clean = clean.groupBy("g", "i").agg(F.max("v").alias("v"))  # reduced before its shuffle; no (group, item) is large
    order = [F.col("g").asc(), F.col("v").desc(), F.col("i").asc()]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = clean.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = {c: clean.schema[c].dataType.simpleString() for c in "giv"}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kept rows (no >= 0), and one row (no = -1) with the row count of the partition's first and last group."""
        here = TaskContext.get().partitionId()
        last, seen, groups = None, 0, 0

        def out(g: pa.Array, i: pa.Array, v: pa.Array, no: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            m = len(g)
            return pa.RecordBatch.from_arrays([g, i, v, pa.array(np.full(m, here, np.int32)), pa.array(no, pa.int64()), pa.array(rows, pa.int64())], names=["g", "i", "v", "part", "no", "rows"])

        def tally(g: pa.Array, rows: int) -> pa.RecordBatch:
            return out(g, pa.nulls(1, types[1]), pa.nulls(1, types[2]), np.array([-1]), np.array([rows]))

        types: list[pa.DataType] = []
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            g, i, v = batch.column(0), batch.column(1), batch.column(2)
            types = [g.type, i.type, v.type]
            new = np.ones(m, dtype=bool)
            if m > 1:
                new[1:] = pc.not_equal(g.slice(1), g.slice(0, m - 1)).to_numpy(zero_copy_only=False)
            if last is not None and g[0].as_py() == last[0].as_py():
                new[0] = False
            starts = np.flatnonzero(new)
            if len(starts) and last is not None and groups == 1:
                yield tally(last, seen + int(starts[0]))  # the first group ends here
            no = np.arange(m) - np.maximum.accumulate(np.where(new, np.arange(m), 0))
            head = int(starts[0]) if len(starts) else m
            no[:head] += seen
            if groups == 0 and len(starts) > 1:
                yield tally(g.slice(0, 1), int(starts[1]))
            groups += len(starts)
            seen = m - int(starts[-1]) if len(starts) else seen + m
            last = g.slice(m - 1, 1)
            keep = np.flatnonzero(no < n)
            if len(keep):
                at = pa.array(keep)
                yield out(g.take(at), i.take(at), v.take(at), no[keep], np.zeros(len(keep), np.int64))
        if last is not None:
            yield tally(last, seen)

    numbered = ordered.mapInArrow(number, f"g {kinds['g']}, i {kinds['i']}, v double, part int, no bigint, rows bigint")
    numbered = written(numbered, "numbered")
    # a group that crosses partitions is the last or first of each: only these few need offsets
    tallies = numbered.where(F.col("no") < 0).select("g", "part", "rows")
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tallies.withColumn("ahead", F.coalesce(F.sum("rows").over(before), F.lit(0))).where(F.col("ahead") > 0)
    # at most two rows per partition
    placed = numbered.where(F.col("no") >= 0).join(F.broadcast(offsets.select("g", "part", "ahead")), ["g", "part"], "left")
    position = F.col("no") + F.coalesce("ahead", F.lit(0)) + 1
    return placed.select(F.col("g").alias(group), F.col("i").alias(item), F.col("v").alias(score), position.alias("position")).where(F.col("position") <= n)
