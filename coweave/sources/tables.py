"""Interactions from files, arrays and generators; results to files and text."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.interactions import as_interactions, binarise


#: Largest number of rows or items of a matrix in arrays.
MOST_INDEX = 2**31 - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder of tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_interactions(spark: SparkSession, path: str, fmt: str = "parquet", user: str = "user", item: str = "item", value: str | None = "value", positive_only: bool = False, **options: str) -> DataFrame:
    """(user, item, value) from any Spark format. ``positive_only`` turns ratings into 1.0 where positive."""
    x = as_interactions(spark.read.format(fmt).options(**options).load(path), user, item, value)
    return binarise(x) if positive_only else x


def from_coo(spark: SparkSession, users: Sequence[int], items: Sequence[int], values: Sequence[float] | None = None) -> DataFrame:
    """(user, item, value) from parallel arrays held by the driver."""
    values = np.ones(len(users)) if values is None else np.asarray(values, dtype=np.float64)
    frame = pd.DataFrame({"user": np.asarray(users, dtype=np.int64), "item": np.asarray(items, dtype=np.int64), "value": values})
    return spark.createDataFrame(frame, "user bigint, item bigint, value double")


def from_csr(spark: SparkSession, data: Sequence[float], indices: Sequence[int], indptr: Sequence[int], n_items: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(interactions, users, items) from compressed rows; checks sizes, lengths, order of ``indptr`` and range of ``indices``.

    The driver holds the arrays, so rows and items are limited to what a 32-bit index can count; larger matrices come as tables.
    """
    data, indices, indptr = np.asarray(data, np.float64), np.asarray(indices), np.asarray(indptr)
    if not 0 <= n_items <= MOST_INDEX or len(indptr) - 1 > MOST_INDEX:
        raise ValueError(f"a matrix of {len(indptr) - 1} rows and {n_items} items is outside the sizes 0 to {MOST_INDEX}")
    if not len(indptr) or indptr[0] != 0:
        raise ValueError("indptr must start with 0")
    if (np.diff(indptr) < 0).any():
        raise ValueError("indptr must be non-decreasing")
    if len(indices) != len(data) or indptr[-1] != len(data):
        raise ValueError(f"indptr ends at {indptr[-1]}, but there are {len(data)} values and {len(indices)} indices")
    if len(indices) and (indices.min() < 0 or indices.max() >= n_items):
        raise ValueError(f"indices must lie in [0, {n_items})")
    users = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    return from_coo(spark, users, indices, data), spark.range(len(indptr) - 1).toDF("user"), spark.range(n_items).toDF("item")


def from_dense(spark: SparkSession, matrix: Sequence[Sequence[float]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(interactions, users, items) from a 2-D array; zeros are left out, empty rows and columns stay in users and items."""
    dense = np.asarray(matrix, dtype=np.float64)
    if dense.ndim != 2:
        raise ValueError(f"the matrix must be 2-D, got {dense.ndim}-D with shape {dense.shape}")
    user, item = np.nonzero(dense)
    return from_coo(spark, user, item, dense[user, item]), spark.range(dense.shape[0]).toDF("user"), spark.range(dense.shape[1]).toDF("item")


def synthetic(spark: SparkSession, n_users: int = 20_000, n_items: int = 2_000, draws: int = 20, seed: int = 42) -> DataFrame:
    """Each user draws items with repetition; all values 1.0. Two multiplicative steps modulo 2**31 - 1 take the place of a random number, so any engine draws alike."""
    draw = spark.range(n_users * draws).select(F.expr(f"id div {draws}").alias("user"), F.expr(f"(id + {seed}) % 2147483647 * 48271 % 2147483647 * 69621 % 2147483647").alias("number"))
    return draw.select("user", (F.col("number") % n_items).alias("item"), F.lit(1.0).alias("value"))


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Weights, scores or recommendations to files."""
    df.write.format(fmt).mode(mode).save(path)


def markdown(rows: list[dict]) -> str:
    """A few result rows (metrics, timings) as a Markdown table."""
    if not rows:
        return ""
    head = list(rows[0])
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in head) + " |" for r in rows])
