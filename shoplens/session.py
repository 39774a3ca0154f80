"""Session settings, tables that are read again, and the rounds of loops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "shoplens", master: str | None = None) -> SparkSession:
    """Session with the settings the operators are designed for.

    Shuffle partitions are left to the cluster: adaptive execution coalesces
    small ones and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


_REUSED: list[DataFrame] = []


def checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def reuse(df: DataFrame) -> DataFrame:
    """``df`` kept by Spark for the steps that read it several times, until ``release``.

    What does not fit in memory goes to the executors' disks; a lost part is computed again.
    """
    kept = df.persist()
    _REUSED.append(kept)
    return kept


def next_round(df: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """The table of one round of a loop, computed.

    With ``spark.checkpoint.dir`` set, the table is written there and read back, which
    cuts the lineage of long loops, and that of the ``last`` round is deleted; otherwise
    rounds are kept as by ``reuse``, since each is computed from the one before.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        table = reuse(df)
        table.count()
    else:
        path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = spark.read.schema(df.schema).parquet(path)
        table.round_path = path
        _REUSED.append(table)
        if last is not None:
            _REUSED[:] = [x for x in _REUSED if x is not last]
            _drop(last)
    return table


def _drop(table: DataFrame) -> None:
    path = getattr(table, "round_path", None)
    if path is None:
        table.unpersist()
    else:
        spark = table.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def release() -> None:
    """Free what ``reuse`` and the last rounds of loops keep, once the results that need it are written."""
    while _REUSED:
        _drop(_REUSED.pop())
