"""Tables in the cluster's shared folder, which cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a temporary one is set for a session on one machine (master ``local``).

    On a cluster an unset folder is a ValueError: executors would write to disks of their own that others cannot read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"intermediate tables need a folder that all executors share: set spark.checkpoint.dir (master {master})")
        folder = f"file://{tempfile.mkdtemp(prefix='coweave-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Later reads neither recompute ``df`` nor depend on any executor, and rows that were numbered while
    written keep their numbers.
    """
    spark = df.sparkSession
    path = "/".join([_own_folder(spark), *_open_scopes, f"{name}-{uuid.uuid4().hex[:12]}"])
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/coweave/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes the tables this application has written; frames that read them cannot be used any more."""
    _delete(spark, _own_folder(spark))


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside are deleted at the end; write or collect results before. Scopes may be nested.

    Results of operators are frames over such tables, so they cannot delete these themselves.
    """
    _open_scopes.append(f"scope-{uuid.uuid4().hex[:12]}")
    folder = "/".join([_own_folder(spark), *_open_scopes])
    try:
        yield
    finally:
        _open_scopes.pop()
        _delete(spark, folder)


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, once per application; needless where it is installed on every node."""
    context = spark.sparkContext
    if _shipped.get("to") == context.applicationId:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="coweave-")) / "coweave.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))  # Spark's own file server hands it to every executor
    _shipped["to"] = context.applicationId


_shipped: dict[str, str] = {}
_open_scopes: list[str] = []
