"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BytePairs

#: Folder of the tokenizers' files; a parameter of every operator here.
TOKENIZERS = os.environ.get("COWEAVE_TOKENIZERS", "/opt/tokenizers")
#: Characters of text that leave as one Arrow batch.
BATCH_CHARS = 4_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str) -> BytePairs:
    """The tokenizer of a rank file, read once per worker process."""
    return BytePairs.load(path)


def rank_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with about BATCH_CHARS of text, so that long texts do not pile up."""
    texts, start, held = batch.column(column).to_pylist(), 0, 0
    for k, text in enumerate(texts):
        held += len(text) if text else 0
        if held >= BATCH_CHARS or k + 1 == len(texts):
            yield batch.slice(start, k + 1 - start), texts[start : k + 1]
            start, held = k + 1, 0


def encode(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """(``keys``, ids: array<int>) of every row, without special tokens. No shuffle: a map over the scan.

    Null and empty texts give an empty list, never null; texts are encoded as they stand, whatever their length. Rows
    are kept as they are, repeated ones included; other columns are not read.
    """
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = tokenizer(path)
        for batch in batches:
            for rows, texts in _portions(batch, len(keys)):
                flat, offsets = pairs.encode_all(texts)
                ids = pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], ids], names=[*keys, "ids"])

    slim = df.select(*keys, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return slim.mapInArrow(run, f"{kinds}, ids array<int>")


def count_tokens(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """(``keys``, n_tokens: bigint): lengths of what `encode` gives, without making the lists."""
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = tokenizer(path)
        for batch in batches:
            counts = [pairs.count(t) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keys, "n_tokens"])

    slim = df.select(*keys, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return slim.mapInArrow(run, f"{kinds}, n_tokens bigint")


def decode(df: DataFrame, ids: str = "ids", keys: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """(``keys``, text) of lists of ids; a null list gives an empty text."""
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = tokenizer(path)
        for batch in batches:
            texts = [pairs.decode(x or ()) for x in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keys, "text"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(ids).alias("_ids")).mapInArrow(run, f"{kinds}, text string")
