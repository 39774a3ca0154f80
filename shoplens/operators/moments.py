"""Pairwise co-moments of many columns in one pass, as matrices that merge.

A batch of rows gives, for every pair of columns and the rows that have both, their
number, the mean of either column, the co-moment and the second moment of either. Two
such tables merge into that of all their rows without loss of precision. A task sends one
table, whatever its number of rows; the tables are merged in two steps, in tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MERGERS = 16
_TABLE = "moments binary"


def batch_moments(values: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Four k x k matrices: rows with both columns i and j; mean of i, second moment of i, co-moment, over these rows."""
    here = present.astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        first = np.array([values[present[:, i], i][0] if present[:, i].any() else 0.0 for i in range(values.shape[1])])
        # Differences to a value that occurs: those of a constant column are 0 exactly.
        shift = np.where(present, values - first, 0.0)
        centre = shift.sum(0) / np.maximum(here.sum(0), 1)
        shift = np.where(present, shift - centre, 0.0)
        both = here.T @ here
        sums, size = shift.T @ here, np.maximum(both, 1)
        squares = (shift * shift).T @ here - sums * sums / size
        products = shift.T @ shift - sums * sums.T / size
        return np.stack([both, (first + centre)[:, None] + sums / size, np.maximum(squares, 0.0), products])


def merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        both = a[0] + b[0]
        size = np.maximum(both, 1)
        apart = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
        weight = a[0] * b[0] / size
        mean = np.where(a[0] > 0, a[1] + apart * b[0] / size, b[1])
        return np.stack([both, mean, a[2] + b[2] + apart * apart * weight, a[3] + b[3] + apart * apart.T * weight])


def correlations(rows: DataFrame, names: Sequence[str], numbers: Sequence[Column]) -> DataFrame:
    """``(x, y, r)`` for each two of the columns and each with itself; a missing number is NULL or NaN."""
    k, names = len(names), list(names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1)
            total = merged_moments(total, batch_moments(values, ~np.isnan(values)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["moments"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            for table in batch.column(0):
                total = merged_moments(total, np.frombuffer(table.as_py()).reshape(4, k, k))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["moments"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in merged(batches):
            total = np.frombuffer(batch.column(0)[0].as_py()).reshape(4, k, k)
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = np.sqrt(total[2]) * np.sqrt(total[2].T)
            r = total[3] / spread
        known = (total[0] > 0) & (spread != 0)
        for i in range(k):
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i]] * k), pa.array(names), pa.array(r[i], mask=~known[i], from_pandas=False)], ["x", "y", "r"])

    tables = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(numbers)]).mapInArrow(counted, _TABLE)
    return tables.repartition(MERGERS).mapInArrow(merged, _TABLE).repartition(1).mapInArrow(pairs, "x string, y string, r double")
