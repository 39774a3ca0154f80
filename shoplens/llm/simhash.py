"""Near-duplicates by SimHash fingerprints and an inverted index over their bytes.

Two 64-bit fingerprints that differ in at most k bits share at least 8 - k of their 8
bytes at the same positions. The index lists fingerprints by position and value of three
bytes (fewer where fewer are sure to be shared); the listed position triples are chosen
so that any 8 - k shared positions contain one. Pairs from a list are filtered by the
tally of shared positional bytes, and only those that reach the minimum are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.llm.components import connected_components
from shoplens.llm.store import written

SEED = 42
BYTES = 8
LIST_CHUNK = 4096  # longer lists are compared chunk by chunk in tasks of their own
_ROWS = 1 << 16


def shingles(text: str | None, words: int) -> list[bytes]:
    """Word shingles of a text, A-Z in lower case, repeats included; of a shorter text, all its words."""
    found = (text or "").encode().lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    line = b" ".join(found)
    ends = list(accumulate(map(len, found), lambda a, b: a + b + 1))
    return [line[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[words - 1 :])]


def fingerprint(text: str | None, words: int = 4) -> bytes:
    """Eight bytes, most significant first; a bit is set if it is in over half of the shingles' XXH64, repeats included."""
    parts = shingles(text, words)
    if not parts:
        return bytes(BYTES)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED))), np.uint8).reshape(-1, BYTES)
    ones = sum(np.unpackbits(hashes[i : i + _ROWS], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), _ROWS))
    return np.packbits(ones * 2 > len(parts)).tobytes()


def fingerprints(docs: DataFrame, words: int, id: str, text: str) -> DataFrame:
    """id, body (the text's XXH64) and node, the fingerprint as a long, of every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), *(T.StructField(n, T.LongType()) for n in ("body", "node"))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.frombuffer(b"".join(fingerprint(x.as_py(), words) for x in batch.column(2)), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], schema.names)

    return docs.select(F.col(id).alias("id"), F.xxhash64(body).alias("body"), body.alias("text")).mapInArrow(compute, schema)


def position_lists(max_bits: int) -> list[tuple[int, ...]]:
    """Byte positions of each index list: every possible set of shared positions contains one of them."""
    shared = BYTES - max_bits
    if not 0 < shared <= BYTES:
        raise ValueError("max_bits must be from 0 to 7")
    size = min(3, shared)
    open_sets = set(combinations(range(BYTES), shared))
    chosen = []
    while open_sets:
        best = max(combinations(range(BYTES), size), key=lambda c: sum(set(c) <= set(s) for s in open_sets))
        chosen.append(best)
        open_sets = {s for s in open_sets if not set(best) <= set(s)}
    return chosen


def list_keys(prints: np.ndarray, lists: list[tuple[int, ...]]) -> np.ndarray:
    """Key of each fingerprint in each list: the list's number and the bytes at its positions."""
    table = prints.astype(">i8").view(np.uint8).reshape(-1, BYTES).astype(np.int64)
    keys = np.empty((len(prints), len(lists)), np.int64)
    for number, positions in enumerate(lists):
        key = np.full(len(prints), number, np.int64)
        for p in positions:
            key = key << 8 | table[:, p]
        keys[:, number] = key
    return keys


def spanning(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the edges, so few that all components stay as they are; edges of fewer bits come first.

    In each round every component takes its first edge to another one, until none is left.
    """
    order = np.argsort(bits, kind="stable")
    a, b, bits = a[order], b[order], bits[order]
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label, left, kept = np.arange(len(nodes)), np.arange(len(a)), []
    while True:
        left = left[label[x[left]] != label[y[left]]]
        if not len(left):
            break
        first = np.full(len(nodes), len(a))
        np.minimum.at(first, label[x[left]], left)
        np.minimum.at(first, label[y[left]], left)
        taken = np.unique(first[first < len(a)])
        kept.append(taken)
        parent, u, v = np.arange(len(nodes)), label[x[taken]], label[y[taken]]
        while (parent[u] != parent[v]).any():
            low = np.minimum(parent[u], parent[v])
            for side in (parent[u], parent[v]):
                np.minimum.at(parent, side, low)
            while (parent[parent] != parent).any():
                parent = parent[parent]
        label = parent[label]
    chosen = np.sort(np.concatenate([np.zeros(0, np.int64), *kept]))
    return a[chosen], b[chosen], bits[chosen]


def _near(keys: np.ndarray, prints: np.ndarray, shared: int, max_bits: int) -> tuple:
    """Edges that connect all near pairs within a key; rows are sorted by their keys."""
    held, size, step = [], 0, 1
    first = np.flatnonzero((keys[1:] == keys[:-1]).all(axis=1)) if len(keys) > 1 else np.zeros(0, np.int64)
    while len(first):
        differ = prints[first] ^ prints[first + step]
        equal = differ.view(np.uint8).reshape(-1, BYTES) == 0
        enough = np.flatnonzero(equal.sum(axis=1) >= shared)  # the count filter
        bits = np.bitwise_count(differ[enough].view(np.uint64)).astype(np.int64)
        enough, bits = enough[bits <= max_bits], bits[bits <= max_bits]
        if len(enough):
            held.append((prints[first[enough]], prints[first[enough] + step], bits))
            size += len(enough)
            if size > 1_000_000:
                held = [spanning(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
        step += 1
        first = first[first + step < len(keys)]
        first = first[(keys[first] == keys[first + step]).all(axis=1)]
    return spanning(*map(np.concatenate, zip(*held))) if held else None


def _meetings(chunk: Column) -> Column:
    """The pairs of chunks (low, high; of ``chunks``) in which a row of this chunk takes part."""
    return F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(
        F.least(x, chunk).alias("low"), F.greatest(x, chunk).alias("high")))


def near_edges(prints: DataFrame, max_bits: int) -> DataFrame:
    """Edges (``a``, ``b``) that connect all of the distinct fingerprints ``node`` that differ in at most ``max_bits`` bits.

    Not each near pair is an edge, but each list's edges connect its near pairs, preferring
    fewer bits, so that a list of n fingerprints gives at most n edges. Lists longer than
    4096 are split into chunks, every two of which meet in one task.
    """
    lists = position_lists(max_bits)
    few = max(1, _ROWS // len(lists))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, few):
                own = batch.column(0)[at : at + few].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(list_keys(own, lists).ravel()), pa.array(np.repeat(own, len(lists)))], ["key", "node"])

    index = prints.select("node").mapInArrow(post, "key long, node long")
    long_lists = index.groupBy("key").count().filter(F.col("count") > LIST_CHUNK).select(
        "key", F.ceil(F.col("count") / LIST_CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = index.join(long_lists, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).select(
        "key", "node", F.explode(_meetings(chunk)).alias("part")).select("key", "part.low", "part.high", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 4), np.int64)

        def edges(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = _near(rows[:, :3], np.ascontiguousarray(rows[:, 3]), BYTES - max_bits, max_bits)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[:2]], ["a", "b"])

        for batch in batches:
            rows = np.concatenate([rest, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)])
            # The last key may go on in the next batch.
            whole = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1)) if len(rows) else []
            cut = whole[-1] + 1 if len(whole) else 0
            yield from edges(rows[:cut])
            rest = rows[cut:]
        yield from edges(rest)

    placed = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return placed.mapInArrow(link, "a long, b long").distinct()


def _linked(docs: DataFrame, words: int, max_bits: int, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """id, body and node of every row; node and root (one per component) of every fingerprint."""
    prints = written(fingerprints(docs, words, id, text), "fingerprints")
    nodes = prints.select("node").distinct()
    roots = nodes.join(connected_components(near_edges(nodes, max_bits)), "node", "left")
    return prints, roots.select("node", F.coalesce("root", "node").alias("root"))


def near_components(docs: DataFrame, words: int = 4, max_bits: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint and component of every row.

    Returns ``id``, fingerprint (16 hexadecimal digits) and component_id, the smallest id
    of the rows that links of at most ``max_bits`` differing bits lead to. Rows of equal
    fingerprint, and so rows of equal text, are one node of the graph. A text without
    words (null, empty, white space) has the fingerprint 0 and is linked like any other.
    Null ids are rows like any other but are never the smallest, unless all are null.
    An empty table gives an empty result; other columns are not read.
    """
    prints, roots = _linked(docs, words, max_bits, id, text)
    least = prints.groupBy("node").agg(F.min("id").alias("_id")).join(roots, "node")
    smallest = least.groupBy("root").agg(F.min("_id").alias("component_id"))
    found = prints.join(least.join(smallest, "root").select("node", "component_id"), "node")
    return found.select(F.col("id").alias(id), F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def component_firsts(docs: DataFrame, words: int = 4, max_bits: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and body (the text's XXH64; of an empty text for null) of one row of each component of ``near_components``.

    It is the row with the smallest id (null ids last), of equal ids the one with the smallest body.
    """
    prints, roots = _linked(docs, words, max_bits, id, text)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "body")
    least = prints.groupBy("node").agg(F.min(order).alias("first")).join(roots, "node")
    return least.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.body")
