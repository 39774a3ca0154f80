"""The shared folder in which long jobs cut their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = Path(tempfile.mkdtemp(prefix="shoplens-llm-")).as_uri()
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mounted(path: str) -> Path:
    """``path`` as a file-system path, for files that workers map into memory.

    Only a mounted folder (a local disk in tests; NFS, Lustre or a FUSE mount on a
    cluster) can be mapped; an object store or HDFS address raises ValueError.
    """
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: memory-mapped files need a mounted shared folder")
    return Path(unquote(parts.path))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``new_folder``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def packed(df: DataFrame, /, *without: str, **keys: Column) -> DataFrame:
    """All columns, except those in ``without``, as one struct ``row``, beside ``keys``: names of ``df`` cannot clash with those of an operator."""
    own = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without] if without else ["*"]
    return df.select(F.struct(*own).alias("row"), *(c.alias(name) for name, c in keys.items()))


def unpacked(df: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``like`` from ``row``, some of them changed; other ``changed`` ones are added at the end."""
    own = [changed.get(c, F.col("row")[c]).alias(c) for c in like.columns]
    return df.select(*own, *(c.alias(name) for name, c in changed.items() if name not in like.columns))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Jobs that run inside have ``key`` set to ``value``."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> AbstractContextManager[None]:
    """Jobs that run inside pass texts to Python in batches of ``rows``, so that a batch of long texts stays small."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """What a query that runs inside shuffles leaves the disks when it ends, not when the driver collects garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
