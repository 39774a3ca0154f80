"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A chunk ends where the gear hash of the last 16 bytes is the smallest within a window on
both sides. Where it ends thus depends on nearby bytes only: an insertion moves the
chunks around it and no others. Each chunk is kept in its first document (smallest id),
where it may stand more than once, and is a repeat elsewhere. Repeats are removed where
the passage that they can stand for has over 50 words, so that a phrase that texts share
by chance stays. A stretch of one repeated word holds the same lowest hash once a word;
cuts there are whole words apart, so that its chunks are alike wherever it begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.llm.store import packed, unpacked
from shoplens.llm.words import SPACE, mix, slices, text_bytes

WINDOW = 16  # bytes on each side: chunks have at least 17 bytes, 34 on average
LONGEST = 1024  # a chunk without a cut for so long is cut there
MIN_WORDS = 51  # words of a passage that is removed
AROUND = 75  # bytes of a passage on either side that need not lie in repeated chunks
STEP = 64  # bytes between cuts where windows are equal, at least
SHARD_BYTES = 16 << 20  # text whose chunks one task settles at once
BLOCK_CHUNKS = 500_000
_GEAR = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 32, 256, np.uint32)
_DIGEST = 16


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte of the 16 bytes that end there: the sum of gear values, each shifted by its distance."""
    total = _GEAR[data]
    for span in (1, 2, 4, 8):
        total[span:] += total[:-span] << np.uint32(span)
    return total


def _lowest(values: np.ndarray, span: int) -> np.ndarray:
    """Smallest of the ``span`` values that begin at each place; shorter at the end."""
    out, have = values.copy(), 1
    while have < span:
        step = min(have, span - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _spaced(places: np.ndarray, window: int) -> np.ndarray:
    """The places, of those that see each other (equal values) the first, the last and some between."""
    near = np.diff(places) <= window
    if not near.any():
        return places
    kept = np.ones(len(places), bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]])))
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        kept[begin + 1 : end] = False
        while begin < end:
            begin = int(np.searchsorted(places, places[begin] + STEP))
            if begin < end:
                kept[begin] = True
    return places[kept]


def chunk_ends(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """End of every chunk of one text's bytes; the last is the text's end."""
    if not len(data):
        return np.zeros(0, np.int64)
    hashes = gear_hashes(data)
    # Positions without a whole window on both sides, at the text's ends, are no cuts.
    inner = np.arange(window, len(data) - window)
    if len(inner):
        lowest = _lowest(hashes, window)
        own, left, right = hashes[inner], lowest[: len(inner)], lowest[window + 1 : window + 1 + len(inner)]
        inner = _spaced(inner[(own <= left) & (own <= right)], window) + 1
    ends = np.append(inner, len(data))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > LONGEST:
        starts = ends - gaps
        ends = np.concatenate([np.append(np.arange(s + LONGEST, e, LONGEST), e) for s, e in zip(starts, ends)])
    return ends


def _digests(data: np.ndarray, ends: np.ndarray) -> bytes:
    view = memoryview(data.tobytes())
    begins = [0, *ends[:-1].tolist()]
    return b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(begins, ends.tolist())])


def _key(id: str, text: str) -> tuple[Column, Column]:
    """Order of documents: by id, null ids last, then by text."""
    return F.coalesce(F.col(id).cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _in_first(digest: np.ndarray, id: np.ndarray, body: np.ndarray) -> np.ndarray:
    """For each row, whether it is of the first document (id, body) of its digest."""
    order = np.lexsort([body, id, digest["b"], digest["a"]])
    ranked, id, body = digest[order], id[order], body[order]
    begins = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(order) else np.zeros(0, np.int64)
    first = np.empty(len(order), bool)
    first[order] = (id == id[at]) & (body == body[at])
    return first


_PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])
_MARKS = "id long, body long, places binary"


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Chunks that an earlier document holds: id, body (hash of the text), places (binary, 32-bit chunk numbers).

    A document with repeats has one row. A task sends each digest once per block, with its
    places in the first document there; places in others are repeats already. So a chunk
    that very many documents hold weighs no more than others in its digest's shard.
    """
    key, body = _key(id, text)
    bodies = docs.select(key.alias("id"), body.alias("body"), F.col(text).cast("string").alias("text"))
    size = bodies.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            counts = [x[2] for x in held]
            digest = np.frombuffer(b"".join(x[3] for x in held), _PAIR)
            ids = np.repeat(np.array([x[0] for x in held], np.int64), counts)
            bodies = np.repeat(np.array([x[1] for x in held], np.int64), counts)
            place = np.concatenate([np.arange(n, dtype=np.int64) for n in counts])
            first = _in_first(digest, ids, bodies)
            rows = np.flatnonzero(first)
            yield from _dealt(digest["a"][rows] % np.uint64(shards), digest[rows], ids[rows], bodies[rows], place[rows])
            rows = np.flatnonzero(~first)
            if len(rows):
                yield _sent(int(ids[rows[0]] % shards), digest[:0], ids[rows], bodies[rows], place[rows])

        for few in chain.from_iterable(slices(batch, 2) for batch in batches):
            data, starts = text_bytes(few.column(2))
            for i, (one, other) in enumerate(zip(few.column(0).to_pylist(), few.column(1).to_pylist())):
                own = data[starts[i] : starts[i + 1] - 1]
                ends = chunk_ends(own, window)
                held.append((one, other, len(ends), _digests(own, ends)))
                size += len(ends)
                if size >= BLOCK_CHUNKS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    sent = "shard int, digests binary, ids binary, bodies binary, places binary"
    blocks = bodies.mapInArrow(send, sent)

    def whole(table: pa.Table, name: str, kind: np.dtype | str, known: bool) -> np.ndarray:
        repeated = pc.equal(pc.binary_length(table.column("digests")), 0).to_pylist()
        parts = [np.frombuffer(x.as_buffer(), kind) for x, y in zip(table.column(name), repeated) if y == known]
        return np.concatenate([np.zeros(0, kind), *parts])

    def settle(table: pa.Table) -> pa.Table:
        ids, bodies, place = (whole(table, *x, False) for x in _PLACED)
        later = np.flatnonzero(~_in_first(whole(table, "digests", _PAIR, False), ids, bodies))
        ids, bodies, place = (np.concatenate([x[later], whole(table, *y, True)]) for x, y in zip((ids, bodies, place), _PLACED))
        # Repeats go by document from here on, many documents in a row.
        part = mix(ids.astype(np.uint64) ^ mix(bodies.astype(np.uint64))) % np.uint64(shards)
        return pa.Table.from_batches(list(_dealt(part, None, ids, bodies, place)), _SENT)

    def gather(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_marked(*(whole(table, *x, True) for x in _PLACED))])

    return blocks.groupBy("shard").applyInArrow(settle, sent).groupBy("shard").applyInArrow(gather, _MARKS)


_SENT = pa.schema([("shard", pa.int32()), *((x, pa.binary()) for x in ("digests", "ids", "bodies", "places"))])
_PLACED = (("ids", "<i8"), ("bodies", "<i8"), ("places", "<u4"))


def _sent(shard: int, digests: np.ndarray, ids: np.ndarray, bodies: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """A block of first places; without digests, a block of places known to be repeats."""
    parts = (digests.tobytes(), ids.tobytes(), bodies.tobytes(), place.astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)],
        ["shard", "digests", "ids", "bodies", "places"])


def _dealt(shard: np.ndarray, digests: np.ndarray | None, ids: np.ndarray, bodies: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block for each shard that has rows."""
    order = np.argsort(shard, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        found = np.zeros(0, _PAIR) if digests is None else digests[rows]
        yield _sent(int(shard[rows[0]]), found, ids[rows], bodies[rows], place[rows])


def _marked(ids: np.ndarray, bodies: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """A row per document."""
    order = np.lexsort([place, bodies, ids])
    ids, bodies, place = ids[order], bodies[order], place[order]
    edges = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (bodies[1:] != bodies[:-1])])) if len(ids) else []
    places = [place[a:b].astype("<u4").tobytes() for a, b in zip(edges, [*edges[1:], len(ids)])]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[edges]), pa.array(bodies[edges]), pa.array(places, pa.binary())], ["id", "body", "places"])


def dedup_substrings(
    docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, min_words: int = MIN_WORDS
) -> DataFrame:
    """All columns, ``text`` without repeated chunks, with n_chunks, n_repeats and removed_bytes.

    Columns of ``docs`` with these three names are replaced.

    A run of repeats is removed if it has, with 75 bytes on either side, at least ``min_words``
    words (a passage begins and ends up to so far outside of chunks that are cut alike):
    between white space where it has some and between characters otherwise. A run
    over a whole text leaves an empty text. n_repeats counts the chunks of removed runs. A chunk
    stays in the document of the smallest id that holds it (null ids last, equal ids by
    the text's hash), wherever it stands there. A null text stays null and has no chunks.
    Rows of equal id and text are one document and get the same result. An empty table
    gives an empty result.
    """
    key, body = _key(id, text)
    found = repeats(docs, id, text, window).withColumn("places", F.array("places"))
    rows = packed(docs, text, key=key, hash=body, value=F.col(text).cast("string"))
    marked = rows.join(found, (F.col("key") == F.col("id")) & (F.col("hash") == F.col("body")), "left").select("row", "value", "places")
    schema = T.StructType([marked.schema["row"], marked.schema["value"], *(
        T.StructField(n, T.LongType()) for n in ("n_chunks", "n_repeats", "removed_bytes"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, 1):
                texts, counts = [], []
                for value, places in zip(few.column(1), few.column(2)):
                    left, numbers = _cut(value.as_py(), places.as_py(), window, min_words)
                    texts.append(left)
                    counts.append(numbers)
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in zip(*counts))], schema.names)

    done = marked.mapInArrow(cut, schema)
    return unpacked(done, docs, **{text: F.col("value"), **{n: F.col(n) for n in ("n_chunks", "n_repeats", "removed_bytes")}})


def _cut(value: str | None, places: list[bytes] | None, window: int, min_words: int) -> tuple[str | None, tuple[int, int, int]]:
    data = np.frombuffer((value or "").encode(), np.uint8)
    ends = chunk_ends(data, window)
    if not places:
        return value, (len(ends), 0, 0)
    repeated = np.zeros(len(ends) + 2, bool)
    repeated[np.concatenate([np.frombuffer(x, "<u4") for x in places]).astype(np.int64) + 1] = True
    steps = np.flatnonzero(repeated[1:] != repeated[:-1])
    borders = np.concatenate([[0], ends])
    left, at, removed = [], 0, 0
    starts = (data & 0xC0) != 0x80
    space = np.concatenate([[True], SPACE[data]])
    words = np.concatenate([[0], np.cumsum(space[:-1] & ~space[1:])])  # words that begin before each place
    for a, b in zip(steps[::2].tolist(), steps[1::2].tolist()):
        first, last = int(borders[a]), int(borders[b])
        if words[min(last + AROUND, len(data))] - words[max(first - AROUND, 0)] < min_words:
            continue
        removed += b - a
        # Whole words are removed; where there are none, whole characters.
        gaps = np.flatnonzero(SPACE[data[first:last]] if SPACE[data[first:last]].any() else starts[first:last])
        begin = first + int(gaps[0]) if first else 0
        end = first + int(gaps[-1]) if last < len(data) else last
        left.append(data[at:begin].tobytes())
        at = max(begin, end)
    left.append(data[at:].tobytes())
    kept = b"".join(left)
    return kept.decode(), (len(ends), removed, len(data) - len(kept))
