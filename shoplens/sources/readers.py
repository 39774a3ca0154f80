"""Reading tables and texts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions.coercion import nan_to_null
from shoplens.functions.text import strip_blanks
from shoplens.sources.office import read_office_lines, read_xlsx
from shoplens.sources.records import csv_records

# Cell texts that mean "missing" in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _missing(c):
    return F.when(~c.isin(list(NA_TOKENS)), c)


def infer_types(df: DataFrame) -> DataFrame:
    """Give string columns the type all their values fit, found in one aggregation."""
    candidates = {
        "bigint": r"^\s*[+-]?\d{1,18}\s*$",
        "double": r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$",
        "boolean": r"^(?i:true|false)$",
    }
    aggs = [F.count(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(df.columns)]
    for dtype, pattern in candidates.items():
        aggs += [F.count_if(F.col(f"`{c}`").rlike(pattern)).alias(f"{dtype}_{i}") for i, c in enumerate(df.columns)]
    counts = df.agg(*aggs).first()
    typed = []
    for i, c in enumerate(df.columns):
        fits = [t for t in candidates if counts[f"n_{i}"] and counts[f"{t}_{i}"] == counts[f"n_{i}"]]
        col = F.col(f"`{c}`")
        typed.append(F.trim(col).try_cast(fits[0]).alias(c) if fits else col)
    return df.select(*typed)


def _split_cells(spark: SparkSession, path: str) -> DataFrame | None:
    """String columns of CSV files with line breaks in cells, read by many tasks a file."""
    records = csv_records(spark, path)
    if records is None:
        return None
    options = {"multiLine": "true", "escape": '"'}
    # Only the first record is read for this.
    names = spark.read.options(header="true", **options).csv(path).columns
    cells = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), options)
    body = records.where(~F.col("first")).select(cells.alias("cells"))
    return body.select(*[F.col(f"cells.c{i}").alias(c) for i, c in enumerate(names)])


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool | str = False
) -> DataFrame:
    """CSV with a header row; NA tokens become NULL and types are inferred after that.

    Inference reads the files once more; give ``schema`` to avoid it on large inputs.
    Large files are split at line ends. Cells with line breaks inside quotes need
    ``multiline="split"``, which finds the records by a scan that counts quotes (see
    ``records.csv_records`` for what it asks of the files) and then splits files as well, or
    ``multiline=True``, which reads a file in one task.
    """
    raw = _split_cells(spark, path) if multiline == "split" else None
    if raw is None:
        reader = spark.read.option("header", True).option("multiLine", multiline is True).option("escape", '"')
        raw = reader.option("inferSchema", False).csv(path)
    raw = raw.select(*[_missing(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if schema is None:
        return infer_types(raw)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    typed = [F.trim(F.col(f"`{c}`")).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType)
             else F.col(f"`{c}`").alias(f.name) for c, f in zip(raw.columns, schema)]
    return nan_to_null(raw.select(*typed))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``: stripped, non-blank lines; undecodable bytes are dropped."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        strip_blanks(F.regexp_replace("value", r"\x{fffd}", "")).alias("text"),
    )
    return lines.where("text != ''")


def read_any(spark: SparkSession, path: str, multiline: bool | str = False) -> DataFrame:
    """A file or pattern by its extension: csv (``multiline`` as in ``read_table``) and xlsx
    as tables, txt, docx and pptx as one row ``(path, text)`` per line.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_table(spark, path, multiline=multiline)
    if kind == "xlsx":
        sheet = read_xlsx(spark, path)
        return infer_types(sheet.select(*[_missing(F.col(f"`{c}`")).alias(c) for c in sheet.columns]))
    if kind == "txt":
        lines = read_lines(spark, path)
    elif kind in ("docx", "pptx"):
        lines = read_office_lines(spark, path)
    else:
        raise ValueError(f"unsupported file type: {kind}")
    if lines.isEmpty():
        raise ValueError("the file holds no text")
    return lines


def read_lexicon(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Parameter file: a JSON object of word -> score, in file order."""
    body = spark.read.text(path, wholetext=True).first()["value"]
    return [(word, int(score)) for word, score in json.loads(body).items()]


def read_words(spark: SparkSession, path: str) -> list[str]:
    """Parameter file: one word per line."""
    return list(dict.fromkeys(r["text"] for r in read_lines(spark, path).collect()))
