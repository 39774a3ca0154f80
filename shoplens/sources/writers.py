"""Writing result tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files with a header, written in parallel."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def save_results(results: Mapping[str, DataFrame], root: str, job_id: str, isolate: bool = False) -> DataFrame:
    """Write every table under ``root/job_id/name``; returns ``(job_id, name, n_rows, path, error)``.

    Rows are counted while they are written. Tables are first written beside the job's
    folder; only when all are there do they take the place of an earlier run's, whose
    manifest goes first. The manifest is written last: without it the tables are not whole.

    With ``isolate``, a table that fails when it is computed does not stop the others: the manifest
    has its message as ``error`` in place of a count and path, and nothing stands under its
    name. If all tables fail, nothing is replaced and the first error is raised.
    """
    if not results:
        raise ValueError("no results to save")
    job, rows, spark = f"{root}/{job_id}", [], next(iter(results.values())).sparkSession
    staged = f"{job}/_staged-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(job).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    failures: list[Exception] = []
    try:
        for name, df in results.items():
            seen = Observation()
            try:
                df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.parquet(f"{staged}/{name}")
            except Exception as error:
                failures.append(error)
                if not isolate or len(failures) == len(results):
                    raise failures[0]
                rows.append((job_id, name, None, None, str(error)))
            else:
                rows.append((job_id, name, seen.get["n_rows"], f"{job}/{name}", None))
        files.delete(path(f"{job}/_manifest"), True)
        for _, name, _, _, error in rows:
            files.delete(path(f"{job}/{name}"), True)
            if error is None and not files.rename(path(f"{staged}/{name}"), path(f"{job}/{name}")):
                raise OSError(f"{job}/{name}: could not be put in place")
    finally:
        files.delete(path(staged), True)
    manifest = spark.createDataFrame(rows, "job_id string, name string, n_rows long, path string, error string")
    manifest.write.parquet(f"{job}/_manifest")
    return manifest
