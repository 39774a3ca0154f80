"""Records of CSV files whose cells hold line breaks, read by many tasks a file."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Task functions travel with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHOLE, END, MIDDLE, BEGINNING = range(4)
PIECES = "path string, start long, kind int, first boolean, text binary"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, start, value)``: lines in the order of the file within a range; ``start`` is the range's first byte."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _quotes(value: str | Column) -> Column:
    return F.length(value) - F.length(F.translate(value, '"', ""))


def open_ranges(lines: DataFrame) -> tuple[dict[str, dict[int, bool]], bool]:
    """File -> first byte of each range -> whether it lies inside a quoted cell; and whether any record has several lines.

    A position is inside a quoted cell if an odd number of quotes stand before it. One row per
    range of a file reaches the driver, which lists the ranges for the scan in any case.
    """
    quotes = _quotes("value")
    counts = lines.groupBy("path", "start").agg(
        F.sum(quotes).alias("quotes"), F.bool_or(quotes % 2 == 1).alias("odd")).collect()
    inside: dict[str, dict[int, bool]] = {}
    before: dict[str, int] = {}
    for path, start, n, _ in sorted(counts):
        inside.setdefault(path, {})[start] = before.get(path, 0) % 2 == 1
        before[path] = before.get(path, 0) + n
    for path, n in before.items():
        if n % 2:
            raise ValueError(f"{path}: a quoted cell does not end")
    return inside, any(r["odd"] for r in counts)


def _pieces(inside: dict[str, dict[int, bool]]):
    """Whole records, and the parts of records that cross the ends of ranges, in Arrow batches."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, is_open, kind, first = None, False, WHOLE, False
        parts: list[bytes] = []

        def ended(kind: int) -> tuple:
            return (*place, kind, first, b"\n".join(parts))

        def left_over() -> list[tuple]:
            """What the range leaves to the next one: a record's beginning, or nothing but its middle."""
            return [ended(MIDDLE if kind == END else BEGINNING)] if parts else []

        for batch in batches:
            paths, starts, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            odd = pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False) % 2
            cuts = [i for i in range(len(paths)) if i == 0 or (paths[i], starts[i]) != (paths[i - 1], starts[i - 1])]
            out: list[tuple] = []
            for begin, end in zip(cuts, [*cuts[1:], len(paths)]):
                header = None
                if (paths[begin], starts[begin]) != place:
                    out += left_over()
                    place, parts, first = (paths[begin], starts[begin]), [], False
                    if place[1] not in inside.get(place[0], {}):
                        raise ValueError(f"{place[0]}: the ranges changed between two scans")
                    is_open = inside[place[0]][place[1]]
                    kind = END if is_open else WHOLE
                    if place[1] == 0:
                        header = next((i for i in range(end - begin) if lines[begin + i].as_py().strip()), None)
                after = (np.cumsum(odd[begin:end]) + is_open) % 2 == 1
                single = ~after & ~np.concatenate([[is_open], after[:-1]])
                if header is not None:
                    single[header] = False
                whole = lines.slice(begin, end - begin).filter(pa.array(single))
                n = len(whole)
                if n:
                    yield _batch([place[0]] * n, [place[1]] * n, [WHOLE] * n, [False] * n, whole)
                for i in map(int, np.flatnonzero(~single)):
                    first = first or i == header
                    parts.append(lines[begin + i].as_py())
                    if not after[i]:
                        out.append(ended(kind))
                        kind, first, parts = WHOLE, False, []
                is_open = bool(after[-1])
            if out:
                yield _batch(*zip(*out))
        if parts:
            yield _batch(*zip(*left_over()))

    return found


def _batch(paths, starts, kinds, firsts, texts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(starts, pa.int64()), pa.array(kinds, pa.int32()),
         pa.array(firsts, pa.bool_()), texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())],
        ["path", "start", "kind", "first", "text"])


def csv_records(spark: SparkSession, path: str) -> DataFrame | None:
    """``(first, text)``: the records of CSV files, ``first`` for the first one of a file; blank ones are left out.

    None if no record has several lines, so that each line is one. Lines end with a line
    feed. One scan counts the quotes of every range of the files, which tells where a range
    begins inside a cell. The ranges are then read side by side; only the parts of records
    that cross the end of a range are grouped, by record. At most two parts a range are
    ordered by file. A record must fit in memory, as in every reader. The files are read three
    times: for the quotes, for whole records and for the parts.

    Line breaks inside cells stay as they are (the one-task reader makes CR LF a line feed
    where lines end so).
    Quotes must stand around cells or be doubled inside them (RFC 4180); a file with an
    odd number of them is an error. Files must not change between the two scans.
    """
    lines = _lines(spark, path)
    inside, several = open_ranges(lines)
    if not several:
        return None
    pieces = lines.withColumn("value", F.col("value").cast("binary")).mapInArrow(_pieces(inside), PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("first", "text")
    parts = pieces.where(F.col("kind") != WHOLE)
    order = W.partitionBy("path").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = parts.withColumn("record", F.count_if(F.col("kind") == BEGINNING).over(order))
    text = F.col("text").cast("string")
    joined = numbered.groupBy("path", "record").agg(
        F.bool_or("first").alias("first"),
        F.sort_array(F.collect_list(F.struct("start", "kind", text.alias("text")))).alias("parts"),
    ).select("first", F.array_join("parts.text", "\n").cast("binary").alias("text"))
    records = whole.unionByName(joined).select("first", F.regexp_replace(F.make_valid_utf8(text), r"\r\z", "").alias("text"))
    return records.where(F.trim("text") != "")
