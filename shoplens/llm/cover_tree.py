"""Exact top-k by inner product with cover trees over queries and data.

Vectors are placed in blocks by their nearest coarse centre; each block of queries and of
data is a cover tree. Two trees are walked together: a pair of nodes is left out when even
the best pair of vectors within their covering radii scores below the worst kth score among
the node's queries. Whole blocks are left out by the same test on their roots.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoplens.llm.store import written

BASE = 1.3  # radius of a level over that of the level below
LEAF = 64  # rows a centre of the lowest level holds on average
DATA_BLOCK = 4096
QUERY_BLOCK = 1024
SAMPLE = 8192  # rows from which the coarse centres are taken
COARSE = 256  # coarse centres of vectors of one length at most
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def _squares(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances between two sets of rows, exact for integers while the products are."""
    return np.maximum((rows**2).sum(axis=1)[:, None] + (others**2).sum(axis=1)[None] - 2 * (rows @ others.T), 0)


def _farthest_first(rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Up to ``count`` distinct rows, each the farthest from those before; their distances then; the largest distance left."""
    chosen, radii = [0], [np.inf]
    squared = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < count and squared.max() > 0:
        chosen.append(int(squared.argmax()))
        radii.append(float(np.sqrt(squared[chosen[-1]])))
        squared = np.minimum(squared, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen), np.array(radii), float(np.sqrt(squared.max()))


def _level(distance: float) -> int:
    """The lowest level whose radius is at least ``distance``."""
    level = int(np.ceil(np.log(distance) / np.log(BASE)))
    while BASE**level < distance:
        level += 1
    while BASE ** (level - 1) >= distance:
        level -= 1
    return level


@dataclass
class CoverTree:
    """Rows in tree order; a node is a range of rows with a row as its centre, a covering radius and children.

    The centres of level i, those of all nodes of level i or above, are rows more than
    BASE**i apart (separation) which hold the centres of level i + 1 (nesting); a node of
    level i lies within BASE**(i + 1) of its parent (covering). A node that is the only
    child of its parent, itself, is not written again. Levels end where there are about
    LEAF rows to a centre; rows belong to the nearest centre of the lowest level.
    """

    ids: np.ndarray
    rows: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    at: np.ndarray  # the row that is the centre
    level: np.ndarray
    radius: np.ndarray
    norm: np.ndarray  # the largest of the node's rows
    children: list[list[int]]

    @property
    def centre(self) -> np.ndarray:
        return self.rows[self.at]

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray) -> CoverTree:
        if not len(rows):
            none = np.zeros(0, np.int64)
            return cls(ids, rows, none, none, none, none, np.zeros(0), np.zeros(0), [])
        size = max(1.0, np.abs(rows).max(initial=0))
        # Squares of very large components would overflow.
        points = rows / size if size > 1e100 else rows
        chosen, radii, left = _farthest_first(points, max(1, -(-len(rows) // LEAF)))
        if len(chosen) == 1:
            low = high = 0
        else:
            high = _level(radii[1])
            low = _level(left) if left > 0 else _level(radii[-1]) - 1
            low = min(low, high - 1) if left <= BASE ** (high - 1) else high
        # The centres of a level are the first ones of the order, those farther than its radius from all before.
        counts = [1] + [int((radii > BASE**level).sum()) for level in range(high - 1, low - 1, -1)]
        between = _squares(points[chosen], points[chosen])
        # Column n: the ancestor, n levels below the root, of each centre of the lowest level.
        paths = np.zeros((counts[-1], len(counts)), np.int64)
        paths[:, -1] = np.arange(counts[-1])
        for n in range(len(counts) - 1, 0, -1):
            parent = np.arange(counts[n])
            parent[counts[n - 1]:] = between[counts[n - 1]:counts[n], :counts[n - 1]].argmin(axis=1)
            paths[:, n - 1] = parent[paths[:, n]]
        own = _squares(points, points[chosen[:counts[-1]]]).argmin(axis=1)
        rank = np.empty(counts[-1], np.int64)
        by_path = np.lexsort(paths.T[::-1])
        rank[by_path] = np.arange(counts[-1])
        order = np.argsort(rank[own], kind="stable")
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        ends = np.cumsum(np.bincount(rank[own], minlength=counts[-1]))
        starts = ends - np.bincount(rank[own], minlength=counts[-1])
        paths, points, rows, ids = paths[by_path], points[order], rows[order], ids[order]

        nodes: list[tuple[int, int, int, int, float, float]] = []
        children: list[list[int]] = []
        above: dict[int, int] = {}  # centre of the level above: its node
        for n in range(len(counts)):
            here: dict[int, int] = {}
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(paths[:, : n + 1], axis=0) != 0).any(axis=1)]))
            for first, last in zip(edges, [*edges[1:], counts[-1]]):
                begin, end, centre = int(starts[first]), int(ends[last - 1]), int(paths[first, n])
                parent = above.get(int(paths[first, n - 1])) if n else None
                if parent is not None and nodes[parent][:2] == (begin, end):
                    here[centre] = parent
                    continue
                at = int(place[chosen[centre]])
                scale = size if size > 1e100 else 1.0
                radius = scale * float(np.sqrt(((points[begin:end] - points[at]) ** 2).sum(axis=1).max()))
                norm = scale * float(np.sqrt((points[begin:end] ** 2).sum(axis=1).max()))
                here[centre] = len(nodes)
                if parent is not None:
                    children[parent].append(len(nodes))
                nodes.append((begin, end, at, high - n, radius, norm))
                children.append([])
            above = here
        return cls(ids, rows, *(np.array(c) for c in zip(*nodes)), children)

    def packed(self) -> bytes:
        """Bytes of the tree, its rows in the narrowest integers that hold them."""
        most = np.abs(self.rows).max(initial=0)
        kind = next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.float64)
        return pickle.dumps({**vars(self), "rows": self.rows.astype(kind)})

    @classmethod
    def unpacked(cls, body: bytes) -> CoverTree:
        fields = pickle.loads(body)
        return cls(**{**fields, "rows": fields["rows"].astype(np.float64)})


class Best:
    """The best k scores so far of each query of a tree, ties by smaller id.

    ``floor`` holds, per query, a score that its kth best is known to reach.
    """

    def __init__(self, tree: CoverTree, k: int, floor: np.ndarray | None = None):
        self.tree, self.k = tree, k
        self.floor = np.full(len(tree.ids), _NONE, np.int64) if floor is None else floor
        self.scores = np.full((len(tree.ids), k), _NONE, np.int64)
        self.ids = np.full((len(tree.ids), k), _LAST, np.int64)

    def worst(self, begin: int, end: int) -> np.ndarray:
        return np.maximum(self.scores[begin:end, -1], self.floor[begin:end])

    def offer(self, begin: int, end: int, scores: np.ndarray, ids: np.ndarray) -> None:
        better = scores >= self.worst(begin, end)[:, None]
        queries = self.tree.ids[begin:end]
        if np.isin(queries, ids).any():
            own = queries[:, None] == ids[None]
            scores = np.where(own, _NONE, scores)
            better &= ~own
        rows = np.flatnonzero(better.any(axis=1))
        if len(rows):
            columns = np.flatnonzero(better[rows].any(axis=0))
            all_scores = np.concatenate([self.scores[begin + rows], scores[np.ix_(rows, columns)]], axis=1)
            all_ids = np.concatenate([self.ids[begin + rows], np.broadcast_to(ids[columns], (len(rows), len(columns)))], axis=1)
            # Never the query itself: its place sorts after empty ones.
            all_ids = np.where(all_scores == _NONE, _LAST, all_ids)
            first = np.lexsort((all_ids, -1 - all_scores), axis=-1)[:, : self.k]
            self.scores[begin + rows] = np.take_along_axis(all_scores, first, axis=1)
            self.ids[begin + rows] = np.take_along_axis(all_ids, first, axis=1)


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all inner products are exact in double precision."""
    most = lambda x: np.abs(x).max(initial=0)
    return bool(most(a) * most(b) * max(1, a.shape[1]) < 1 << 53)


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return np.rint(a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in side] for side in (a, b)]
    return np.array([[min(max(sum(map(int.__mul__, x, y)), _NONE + 1), _LAST) for y in whole[1]] for x in whole[0]], np.int64)


def dual_search(queries: CoverTree, data: CoverTree, best: Best) -> None:
    """Offer to ``best`` every score that can be among the best k."""
    if not len(queries.ids) or not len(data.ids):
        return
    exact = _exact(queries.rows, data.rows)
    query_centre, data_centre = queries.centre, data.centre
    query_norm = np.linalg.norm(query_centre, axis=1)
    data_norm = np.linalg.norm(data_centre, axis=1)

    def bound(q: int, nodes: list[int]) -> np.ndarray:
        """The most that any pair of the two balls can score, with room for rounding.

        By the product of centres and radii, and by the squared distance, which the gap
        between the balls bounds from below: 2ab = a² + b² - (a - b)².
        """
        if not exact:
            return np.full(len(nodes), np.inf)
        r = data.radius[nodes]
        most = data_centre[nodes] @ query_centre[q] + queries.radius[q] * (data_norm[nodes] + r) + r * query_norm[q]
        gap = np.maximum(np.sqrt(((data_centre[nodes] - query_centre[q]) ** 2).sum(axis=1)) - r - queries.radius[q], 0)
        most = np.minimum(most, (data.norm[nodes] ** 2 + queries.norm[q] ** 2 - gap**2) / 2)
        most = np.minimum(most, data.norm[nodes] * queries.norm[q])
        return most + 1e-9 * (np.abs(most) + 1) + 0.5

    todo = [(0, 0, np.inf)]
    while todo:
        q, d, most = todo.pop()
        begin, end = queries.begin[q], queries.end[q]
        if most < best.worst(begin, end).min():
            continue
        if queries.children[q] and (not data.children[d] or end - begin > data.end[d] - data.begin[d]):
            todo += [(child, d, bound(child, [d])[0]) for child in queries.children[q]]
        elif data.children[d]:
            children = data.children[d]
            limits = bound(q, children)
            # The most promising last, so that it is taken first.
            todo += [(q, children[i], limits[i]) for i in np.argsort(limits)]
        else:
            rows = slice(data.begin[d], data.end[d])
            best.offer(begin, end, _products(queries.rows[begin:end], data.rows[rows], exact), data.ids[rows])


def _whole(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of floor(64 * x) of vectors of one length."""
    return np.floor(64 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(vectors), dims)


def _placed(vectors: DataFrame, cells: int) -> DataFrame:
    """``vectors`` with ``cell``, the nearest of up to ``cells`` coarse centres of their length (0 where there is none)."""
    sample: dict[int, list[list[float]]] = {}
    for row in vectors.orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE).select("dims", "vector").collect():
        sample.setdefault(row["dims"], []).append(row["vector"])
    centres = {}
    for dims, rows in sample.items():
        whole = np.floor(64 * np.array(rows, np.float64)).reshape(len(rows), dims)
        if dims and np.abs(whole).max() < 1e100:
            centres[dims] = whole[_farthest_first(whole, cells)[0]]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = batch.column("dims").to_numpy(), batch.column("vector")
            cell = np.zeros(len(dims), np.int32)
            for length in np.unique(dims):
                if length in centres:
                    rows = np.flatnonzero(dims == length)
                    whole = _whole(vectors.take(pa.array(rows)), length)
                    # The squares of the rows do not decide which centre is nearest.
                    far = (centres[length] ** 2).sum(axis=1)[None] - 2 * (whole @ centres[length].T)
                    cell[rows] = np.where(np.isnan(far), np.inf, far).argmin(axis=1)
            yield batch.append_column("cell", pa.array(cell, pa.int32()))

    return vectors.mapInArrow(place, "id long, vector array<double>, dims int, cell int")


def _blocks(placed: DataFrame, rows: int, name: str) -> DataFrame:
    """One row per block: dims, block, number of blocks of these dims, size, root ball and tree.

    A cell of more than ``rows`` vectors, whatever its share, is dealt to several blocks by hash.
    """
    cells = placed.groupBy("dims", "cell").agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / rows).cast("int"))
    # A window over at most COARSE cells.
    by_cell = Window.partitionBy("dims").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("dims", "cell", "pieces", F.coalesce(F.sum("pieces").over(by_cell), F.lit(0)).cast("int").alias("first"),
                         F.sum("pieces").over(Window.partitionBy("dims")).cast("int").alias("blocks"))
    piece = F.pmod(F.xxhash64("id", "vector"), F.col("pieces")).cast("int")
    dealt = placed.join(cells, ["dims", "cell"]).select("dims", "id", "vector", "blocks", (F.col("first") + piece).alias("block"))

    def build(table: pa.Table) -> pa.Table:
        dims, block, blocks = (table.column(c)[0].as_py() for c in ("dims", "block", "blocks"))
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        matrix = _whole(table.column("vector").combine_chunks(), dims)
        tree = CoverTree.build(table.column("id").to_numpy()[order], matrix[order])
        return pa.table({"dims": pa.array([dims], pa.int32()), "block": pa.array([block], pa.int32()),
                         "blocks": pa.array([blocks], pa.int32()), "n": pa.array([len(order)], pa.int64()),
                         "most": pa.array([float(np.abs(matrix).max(initial=0))]),
                         "centre": pa.array([tree.centre[0].tolist()], pa.list_(pa.float64())),
                         "radius": pa.array([float(tree.radius[0])]), "norm": pa.array([float(tree.norm[0])]),
                         "tree": pa.array([tree.packed()], pa.binary())})

    schema = "dims int, block int, blocks int, n long, most double, centre array<double>, radius double, norm double, tree binary"
    return written(dealt.groupBy("dims", "block").applyInArrow(build, schema), name)


def _inner(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def block_pairs(queries: DataFrame, data: DataFrame) -> DataFrame:
    """(dims, query_block, block, n, likely, bound): pairs of blocks by their roots alone.

    ``likely`` is the score of the two roots, ``bound`` the most that two vectors of the balls can score.
    """
    def ball(df: DataFrame, side: str, block: str) -> DataFrame:
        return df.select("dims", F.col("block").alias(block), *(F.col(c).alias(f"{side}_{c}") for c in ("n", "most", "centre", "radius", "norm")),
                         F.col("blocks").alias(f"{side}_blocks"), F.sqrt(_inner("centre", "centre")).alias(f"{side}_far"))

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # How many blocks the other side has: one row per length of vector.
    n_data = data.select("dims", "blocks").distinct().withColumnRenamed("blocks", "others")
    n_queries = queries.select("dims", "blocks").distinct().withColumnRenamed("blocks", "others")
    left = ball(queries, "q", "query_block").join(n_data, "dims").withColumn("block", numbers("others")).drop("others")
    right = ball(data, "d", "block").join(n_queries, "dims").withColumn("query_block", numbers("others")).drop("others")
    likely = _inner("q_centre", "d_centre")
    gap = F.greatest(F.sqrt(F.aggregate(F.zip_with("q_centre", "d_centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
                     - F.col("q_radius") - F.col("d_radius"), F.lit(0.0))
    most = F.least(F.col("likely") + F.col("q_radius") * (F.col("d_far") + F.col("d_radius")) + F.col("d_radius") * F.col("q_far"),
                   (F.col("q_norm") * F.col("q_norm") + F.col("d_norm") * F.col("d_norm") - gap * gap) / 2,
                   F.col("q_norm") * F.col("d_norm"))
    exact = F.col("q_most") * F.col("d_most") * F.greatest(F.lit(1), "dims") < float(1 << 53)
    bound = F.when(exact, most + 1e-9 * (F.abs(most) + 1) + 0.5).otherwise(F.lit(float("inf")))
    pairs = left.join(right, ["dims", "query_block", "block"]).withColumn("likely", likely)
    return pairs.select("dims", "query_block", "block", F.col("d_n").alias("n"), "likely", bound.alias("bound"))


def surviving_pairs(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """(dims, query_block, block, bound, floor): the pairs of blocks that can hold one of the best ``k``.

    Each block of queries first searches one block of data, that of the nearest roots with
    over ``k`` rows; the kth scores found (``floor``, in tree order) leave out all pairs whose
    roots bound every score below them.
    """
    pairs = written(block_pairs(queries, data), "block-pairs")
    first = pairs.filter(F.col("n") > k).groupBy("dims", "query_block").agg(F.max_by("block", F.struct("likely", "block")).alias("block"))
    trees = (first.join(queries.select("dims", F.col("block").alias("query_block"), F.col("tree").alias("queries")), ["dims", "query_block"])
             .join(data.select("dims", "block", F.col("tree").alias("data")), ["dims", "block"]))

    def kth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                best = Best(CoverTree.unpacked(batch.column(2)[i].as_py()), k)
                dual_search(best.tree, CoverTree.unpacked(batch.column(3)[i].as_py()), best)
                floor = pa.array([best.scores[:, -1].tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:i + 1], batch.column(1)[i:i + 1], floor], ["dims", "query_block", "floor"])

    floors = written(trees.select("dims", "query_block", "queries", "data").mapInArrow(kth, "dims int, query_block int, floor array<long>"), "floors")
    kept = pairs.join(floors, ["dims", "query_block"], "left").filter(
        F.col("floor").isNull() | (F.col("bound") >= F.array_min("floor").cast("double")))
    return kept.select("dims", "query_block", "block", "bound", "floor")


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, id: str = "vec_id", vector: str = "embedding",
    query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK,
) -> DataFrame:
    """The ``k`` highest scores of each row whose id is divisible by ``every``, against all rows of other ids.

    Components are taken as floor(64 * x); the score is the integer inner product.
    Returns query_id, rank (from 1), ``id`` and score, ties by smaller id; fewer than
    ``k`` rows if there are not as many. Rows with a null id, a null vector, or null or
    non-finite components (after the multiplication, too) take no part; equal rows count
    once; vectors meet vectors of as many components. Scores beyond the range of a long are its ends.

    Coarse centres come from SAMPLE rows, the first by a hash; every row is placed and
    searched. Trees are sent only for the pairs of blocks of ``surviving_pairs``, the most
    promising first; a task keeps the best scores of its query block meanwhile.
    """
    double = F.col(vector).cast("array<double>")
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 64) < float("inf")))
    valid = vectors.filter(F.col(id).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id).cast("long").alias("id"), double.alias("vector"), F.size(vector).alias("dims")).distinct()
    valid = written(valid, "vectors")
    # As many cells as full blocks: smaller ones would only make more pairs.
    cells = min(COARSE, max(1, -(-valid.count() // data_block)))
    placed = written(_placed(valid, cells), "placed")
    data = _blocks(placed, data_block, "data-trees")
    queries = _blocks(placed.filter(F.col("id") % every == 0), query_block, "query-trees")
    kept = surviving_pairs(queries, data, k)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key != now:
                    if best is not None:
                        yield _found(best)
                    floor = batch.column(2)[i]
                    floor = np.array(floor.as_py(), np.int64) if floor.is_valid else None
                    now, best = key, Best(CoverTree.unpacked(batch.column(3)[i].as_py()), k, floor)
                dual_search(best.tree, CoverTree.unpacked(batch.column(4)[i].as_py()), best)
        if best is not None:
            yield _found(best)

    left = queries.select("dims", F.col("block").alias("query_block"), F.col("tree").alias("queries"))
    right = data.select("dims", "block", F.col("tree").alias("data"))
    pairs = (kept.join(left, ["dims", "query_block"]).join(right, ["dims", "block"])
             .sortWithinPartitions("dims", "query_block", F.desc("bound"))
             .select("dims", "query_block", "floor", "queries", "data"))
    found = pairs.mapInArrow(search, "query_id long, id long, score long").distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")


def _found(best: Best) -> pa.RecordBatch:
    there = best.ids != _LAST
    ids = np.broadcast_to(best.tree.ids[:, None], best.ids.shape)
    return pa.RecordBatch.from_arrays([pa.array(x[there]) for x in (ids, best.ids, best.scores)], ["query_id", "id", "score"])
