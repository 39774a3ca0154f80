"""Centroid clustering (Lloyd's rounds) with heap-ordered bounds, in exact integers.

A block holds some thousand vectors and, for each cluster, a heap of its vectors ordered
by the gap between the distance to the second-nearest and to the nearest centroid. A
round in which centroids move lowers all gaps of a cluster by the same amount at most, so
nothing in the heap is touched: the amount is added to the cluster's accumulated drift,
and a vector's gap has expired once its key (gap when measured, plus the drift then) is
not above the drift. Only expired vectors are popped, compared with all centroids, and
pushed into the heap of their cluster. Tasks report how the sums of clusters change, so a
round costs what moved. Blocks pass from round to round as a table in the shared folder;
only sums of clusters, k times the number of components, reach the driver.

Defined results: vectors that are null, of another length, or with null or non-finite
components are left out; repeated rows are vectors each; a vector without id is never a
first centroid unless too few have one; with fewer than k vectors there are as many
centroids as vectors; an empty table gives no rows. Components of any size are exact
(Python integers beyond 2^26); a distance or inertia beyond a long is given as its end.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.store import new_folder, remove, written

BLOCK_ROWS = 8192
_NARROW = 1 << 26  # squared distances of narrower integers over 64 components stay below 2^60
_LONG = (1 << 63) - 1
_LIMB = 48  # sums travel as limbs of so many bits, which Spark adds over all tasks as decimals
_LIMBS = 24  # for doubles of any size; only limbs other than 0 are sent
_STATE = "ids array<bigint>, width string, vectors binary, sizes array<int>, keys array<double>, members array<int>, changes map<int,bigint>"
_FOUND = "id long, cluster int, distance long, changes map<int,bigint>"
_STATE_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.string()), ("vectors", pa.binary()), ("sizes", pa.list_(pa.int32())),
                          ("keys", pa.list_(pa.float64())), ("members", pa.list_(pa.int32())), ("changes", pa.map_(pa.int32(), pa.int64()))])
_FOUND_ARROW = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("changes", pa.map_(pa.int32(), pa.int64()))])


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit integers, or Python integers where one is too wide."""
    scaled = np.floor(values * float(scale))
    if not scaled.size or np.abs(scaled).max() < _NARROW:
        return scaled.astype(np.int64)
    whole = np.empty(scaled.shape, object)
    whole.ravel()[:] = [math.floor(x) if math.isfinite(x) else math.floor(y) * scale for x, y in zip(scaled.ravel(), values.ravel())]
    return whole


def squared_distances(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of every row of ``values`` to every centroid."""
    if values.dtype == object or centroids.dtype == object:
        return np.array([[sum(d * d for d in (x - c).tolist()) for c in centroids.astype(object)] for x in values.astype(object)],
                        object).reshape(len(values), len(centroids))
    wide = int(np.abs(values).max(initial=0)) * int(np.abs(centroids).max(initial=0)) * values.shape[1]
    kind = np.float64 if wide < 1 << 52 else np.int64  # doubles hold such products exactly
    products = (values.astype(kind) @ centroids.astype(kind).T).astype(np.int64)
    return (values * values).sum(1)[:, None] - 2 * products + (centroids * centroids).sum(1)[None, :]


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid (ties: the smaller) and a lower bound of the gap to the next one."""
    squares = squared_distances(values, centroids)
    rows = np.arange(len(values))
    first = squares.argmin(1) if len(values) else np.zeros(0, np.int64)
    if len(centroids) == 1:
        return first, np.full(len(values), np.inf)
    best = squares[rows, first]
    squares[rows, first] = squares.max(initial=0) + 1
    near, next_near = np.sqrt(best.astype(np.float64)), np.sqrt(squares.min(1).astype(np.float64))
    return first, next_near - near - 1e-12 * (next_near + near)


class Block:
    """Vectors with one heap for each cluster; ``drifts`` are the clusters' accumulated drifts."""

    def __init__(self, ids: list[int | None], values: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.ids, self.values, self.heaps = ids, values, heaps

    @classmethod
    def new(cls, ids: list[int | None], values: np.ndarray, centroids: np.ndarray, changes: np.ndarray) -> Block:
        block = cls(ids, values, [[] for _ in range(len(centroids))])
        block.push(np.arange(len(values)), centroids, [0.0] * len(centroids), changes)
        return block

    def push(self, rows: np.ndarray, centroids: np.ndarray, drifts: list[float], changes: np.ndarray) -> None:
        """Compare ``rows`` with all centroids and put them into the heaps; ``changes`` gets their counts and sums."""
        clusters, gaps = nearest(self.values[rows], centroids)
        for number in np.unique(clusters).tolist():
            own = rows[clusters == number]
            keys = gaps[clusters == number] + drifts[number]
            finite = np.isfinite(keys)
            keys[finite] -= 1e-12 * np.abs(keys[finite])
            for item in zip(keys.tolist(), own.tolist()):
                heapq.heappush(self.heaps[number], item)
            self._count(number, own, 1, changes)

    def _count(self, number: int, rows: np.ndarray, sign: int, changes: np.ndarray) -> None:
        changes[number, 0] += sign * len(rows)
        changes[number, 1:] += sign * self.values[rows].sum(0).astype(object)

    def move(self, centroids: np.ndarray, drifts: list[float], changes: np.ndarray) -> int:
        """Pop the vectors whose gap has expired and assign them anew; how many they were."""
        popped = []
        for number, heap in enumerate(self.heaps):
            expired = []
            while heap and heap[0][0] <= drifts[number]:
                expired.append(heapq.heappop(heap)[1])
            if expired:
                self._count(number, np.array(expired), -1, changes)
                popped += expired
        if popped:
            self.push(np.array(popped), centroids, drifts, changes)
        return len(popped)

    def distances(self, centroids: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Cluster of each row and its squared distance to that centroid alone."""
        clusters, squares = np.zeros(len(self.ids), np.int32), [0] * len(self.ids)
        for number, heap in enumerate(self.heaps):
            own = [row for _, row in heap]
            if own:
                clusters[own] = number
                for row, square in zip(own, squared_distances(self.values[own], centroids[number : number + 1])[:, 0].tolist()):
                    squares[row] = square
        return clusters, squares

    def to_arrow(self) -> pa.RecordBatch:
        top = int(np.abs(self.values).max(initial=0))
        width = "text" if self.values.dtype == object else next(w for w, limit in (("i1", 127), ("i2", 32767), ("i4", _NARROW)) if top <= limit)
        data = ",".join(map(str, self.values.ravel())).encode() if width == "text" else self.values.astype(width).tobytes()
        items = [item for heap in self.heaps for item in heap]
        columns = [[self.ids], [width], [data], [[len(h) for h in self.heaps]], [[k for k, _ in items]], [[r for _, r in items]], [None]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STATE_ARROW)], schema=_STATE_ARROW)

    @classmethod
    def from_row(cls, row: dict, dims: int) -> Block:
        if row["width"] == "text":
            values = np.array([int(x) for x in row["vectors"].split(b",")], object)
        else:
            values = np.frombuffer(row["vectors"], row["width"]).astype(np.int64)
        heaps, at, items = [], 0, list(zip(row["keys"], row["members"]))
        for size in row["sizes"]:
            heaps.append(items[at : at + size])
            at += size
        return cls(row["ids"], values.reshape(-1, dims), heaps)


def _limbs(values: np.ndarray) -> list[tuple[int, int]]:
    out = []
    for place, x in enumerate(values.ravel().tolist()):
        sign, rest, limb = (-1 if x < 0 else 1), abs(x), place * _LIMBS
        while rest:
            if part := rest & ((1 << _LIMB) - 1):
                out.append((limb, sign * part))
            rest, limb = rest >> _LIMB, limb + 1
    return out


def _total(table: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the tasks' ``changes``; as many rows as ``shape`` has places and limbs reach the driver."""
    parts = table.filter("changes IS NOT NULL").select(F.explode("changes").alias("place", "value"))
    sums = {r[0]: int(r[1]) for r in parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(20,0)"))).collect()}
    flat = [sum(sums.get(p * _LIMBS + i, 0) << (_LIMB * i) for i in range(_LIMBS)) for p in range(math.prod(shape))]
    whole = np.empty(shape, object)
    whole.ravel()[:] = flat
    return whole


def _changes_row(schema: pa.Schema, changes: np.ndarray) -> pa.RecordBatch:
    columns = [[_limbs(changes)] if f.name == "changes" else [None] for f in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _array(rows: list[list[int]]) -> np.ndarray:
    """Centroids as 64-bit integers where all are narrow, as Python integers otherwise."""
    narrow = all(abs(x) < _NARROW for row in rows for x in row)
    return np.array(rows, np.int64 if narrow else object)


def _first_blocks(scale: int, centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    changes = np.zeros((len(centroids), centroids.shape[1] + 1), object)
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            values = integers(flat.reshape(part.num_rows, centroids.shape[1]), scale)
            yield Block.new(part.column(0).to_pylist(), values, centroids, changes).to_arrow()
    yield _changes_row(_STATE_ARROW, changes)


def _blocks(centroids: np.ndarray, drifts: list[float], changes: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks of a state table after their expired vectors were assigned anew."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["ids"] is not None:
                block = Block.from_row(row, centroids.shape[1])
                block.move(centroids, drifts, changes)
                yield block


def _next_blocks(centroids: np.ndarray, drifts: list[float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    changes = np.zeros((len(centroids), centroids.shape[1] + 1), object)
    for block in _blocks(centroids, drifts, changes, batches):
        yield block.to_arrow()
    yield _changes_row(_STATE_ARROW, changes)


def _final_rows(centroids: np.ndarray, drifts: list[float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    changes = np.zeros((len(centroids), centroids.shape[1] + 1), object)
    inertia = np.zeros(len(centroids), object)
    for block in _blocks(centroids, drifts, changes, batches):
        clusters, squares = block.distances(centroids)
        squares = [min(x, _LONG) for x in squares]
        np.add.at(inertia, clusters, np.array(squares, object))
        columns = [block.ids, clusters, squares, [None] * len(squares)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND_ARROW)], schema=_FOUND_ARROW)
    yield _changes_row(_FOUND_ARROW, inertia)


def _upper_root(x: int) -> float:
    return math.sqrt(x) * (1 + 1e-12)


def _drift(old: list[list[int]], new: list[list[int]]) -> list[float]:
    """By how much a gap of each cluster can have shrunk: its own move and the largest move of another."""
    moves = [_upper_root(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(old, new)]
    return [(own + max((m for j, m in enumerate(moves) if j != i), default=0.0)) * (1 + 1e-12) for i, own in enumerate(moves)]


def centroid_clusters(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Cluster of every vector after ``rounds`` rounds and a last assignment.

    Columns: the id, cluster, distance (squared, between integers floor(scale * x)),
    cluster_inertia, inertia, centroid_sha256 (of the final centroid's integers joined by commas).
    First centroids are the k vectors with the smallest SHA-256 of ``seed:id``.
    """
    spark = vectors.sparkSession
    value = F.col(vector).cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col(id).cast("long").alias("id"), value.alias("value")).filter((F.size("value") == dims) & ~bad)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = kept.orderBy(digest.asc_nulls_last(), "value").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], f"{id} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = [[int(x) for x in integers(np.array([r["value"]], np.float64), scale)[0].tolist()] for r in starts]
    sums = np.zeros((len(centroids), dims + 1), object)
    drifts = [0.0] * len(centroids)
    step, state, path = partial(_first_blocks, scale, _array(centroids)), kept, None
    for number in range(rounds):
        new_path = new_folder(spark, f"clusters-{number}")
        state.mapInArrow(step, _STATE).write.parquet(new_path)
        if path is not None:
            remove(spark, path)
        path, state = new_path, spark.read.schema(_STATE).parquet(new_path)
        sums += _total(state, sums.shape)
        moved = [[int(s // row[0]) for s in row[1:]] if row[0] else old for row, old in zip(sums, centroids)]
        drifts = [a + b for a, b in zip(drifts, _drift(centroids, moved))]
        centroids = moved
        step = partial(_next_blocks, _array(centroids), drifts)
    if path is None:  # no rounds: the first assignment is the last
        path = new_folder(spark, "clusters")
        state.mapInArrow(step, _STATE).write.parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
    found = written(state.mapInArrow(partial(_final_rows, _array(centroids), drifts), _FOUND), "clustered")
    remove(spark, path)
    inertia = [int(x) for x in _total(found, (len(centroids),))]
    whole = min(sum(inertia), _LONG)
    facts = [
        (i, min(own, _LONG), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, (own, c) in enumerate(zip(inertia, centroids))
    ]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = found.filter("changes IS NULL").join(F.broadcast(table), "cluster")  # k rows
    return rows.select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
