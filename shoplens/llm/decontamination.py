"""Benchmark decontamination by spaced seeds.

A mask picks some of the words of a window and ignores the others, so a passage is still
hit where ignored words were replaced. Masked hashes of benchmark items and documents
are joined; around each hit the words of both are compared in place, and an overlap that
is long and alike enough is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.llm.store import written
from shoplens.llm.words import mix, slices, word_hashes

# Masks of weight 5, chosen greedily by how many sets of mismatches they hit; the words under a 0 are ignored.
MASKS = ("110111", "110001011", "11010011", "111011")
MIN_ITEM_WORDS = 5  # shorter items would be hit by common phrases
MIN_WORDS = 12  # of an overlap; of a shorter item all words
MIN_IDENTITY = 0.75
FILTER_BITS = (20, 28)  # places of each table of the filter, as a power of 2: least and most, 64 MB for both
_FACTORS = mix(np.arange(100, 356, dtype=np.uint64)) | np.uint64(1)


def patterns(short_lengths: list[int]) -> list[tuple[int, ...]]:
    """Positions of each mask, and of whole short items, which are compared exactly."""
    return [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS] + [tuple(range(n)) for n in short_lengths]


def seed_keys(hashes: np.ndarray, before: np.ndarray, pattern: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Key at every word at which the pattern fits into its text, and the word's number."""
    span = pattern[-1] + 1
    if len(hashes) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    fits = np.arange(len(hashes) - span + 1)
    ends = np.repeat(before[1:], np.diff(before))[fits]
    fits = fits[fits + span <= ends]
    total = np.full(len(fits), mix(np.array([len(pattern)], np.uint64))[0])
    for factor, place in zip(_FACTORS, pattern):
        total += hashes[fits + place] * factor * np.uint64(2 * place + 1)
    return mix(total), fits


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """item, words (binary hashes) and n of every item that is long enough."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, 1):
                hashes, _, _, before = word_hashes(few.column(1))
                words = [hashes[a:b].tobytes() for a, b in zip(before[:-1], before[1:])]
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array(words, pa.binary()), pa.array(np.diff(before).astype(np.int32))],
                    ["item", "words", "n"])

    schema = T.StructType([T.StructField("item", benchmark.schema[item].dataType), T.StructField("words", T.BinaryType()),
                           T.StructField("n", T.IntegerType())])
    found = benchmark.select(benchmark[item], benchmark[text].cast("string")).mapInArrow(read, schema)
    return written(found.filter(F.col("n") >= MIN_ITEM_WORDS).distinct(), "items")


def _seeds(items: DataFrame, shapes: list[tuple[int, ...]]) -> DataFrame:
    """key, item, n and place (of the seed in the item): one row per masked window."""
    longest = max(len(m) for m in MASKS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in enumerate(batch.column(1)):
                hashes = np.frombuffer(words.as_py(), np.uint64)
                keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for number, shape in enumerate(shapes):
                    if number < len(MASKS) or len(shape) == len(hashes) < longest:
                        key, place = seed_keys(hashes, np.array([0, len(hashes)]), shape)
                        keys.append(key)
                        places.append(place)
                key, place = np.concatenate(keys), np.concatenate(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column(0).take(pa.array([i] * len(key), pa.int32())),
                     pa.array([len(hashes)] * len(key), pa.int32()), pa.array(place.astype(np.int32))], ["key", "item", "n", "place"])

    schema = T.StructType([T.StructField("key", T.LongType()), items.schema["item"], T.StructField("n", T.IntegerType()),
                           T.StructField("place", T.IntegerType())])
    return written(items.select("item", "words").mapInArrow(read, schema), "seeds")


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in the filter, from different bits."""
    size = np.uint64(1 << bits)
    return (keys % size).astype(np.int64), ((keys >> np.uint64(32)) % size).astype(np.int64) + (1 << bits)


def _known(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (packed[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """Two bits for each key, in two tables of 16 places a key; beyond their most, more windows pass and meet the join."""
    size = max(FILTER_BITS[0], min(FILTER_BITS[1], int(seeds.count()).bit_length() + 4))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(2 << (size - 3), np.uint8)
        for batch in batches:
            for places in _slots(batch.column(0).to_numpy().view(np.uint64), size):
                np.bitwise_or.at(found, places >> 3, np.uint8(1) << (places & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(2 << (size - 3), np.uint8)
    for row in seeds.select("key").coalesce(8).mapInArrow(bits, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out, size


_REGIONS = "id long, body long, start int, words binary, hits array<struct<key:long,at:int>>"


def _regions(docs: DataFrame, shapes: list[tuple[int, ...]], known: tuple[np.ndarray, int], around: int, id: str, text: str) -> DataFrame:
    """Parts of documents with possible hits: their words, ``around`` words on either side included, and the hits in them."""
    shared, size = docs.sparkSession.sparkContext.broadcast(known[0]), known[1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, 2):
                hashes, _, _, before = word_hashes(few.column(2))
                found = []
                for shape in shapes:
                    key, place = seed_keys(hashes, before, shape)
                    low, high = _slots(key, size)
                    hit = np.flatnonzero(_known(shared.value, low))
                    hit = hit[_known(shared.value, high[hit])]
                    found.append((key[hit], place[hit]))
                key, at = (np.concatenate(x) for x in zip(*found))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                key, at = key[order].view(np.int64), at[order]
                owner = np.searchsorted(before, at, "right") - 1
                cuts = np.flatnonzero((np.diff(at) > 2 * around) | (np.diff(owner) > 0)) + 1
                rows = []
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                    doc = owner[a]
                    begin = max(int(at[a]) - around, int(before[doc]))
                    end = min(int(at[b - 1]) + around, int(before[doc + 1]))
                    rows.append({
                        "id": few.column(0)[doc].as_py(), "body": few.column(1)[doc].as_py(), "start": begin - int(before[doc]),
                        "words": hashes[begin:end].tobytes(),
                        "hits": [{"key": k, "at": p - begin} for k, p in zip(key[a:b].tolist(), at[a:b].tolist())],
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=_REGION_ARROW)

    body = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return written(docs.select(F.col(id).cast("long"), body, F.col(text).cast("string")).mapInArrow(read, _REGIONS), "regions")


_REGION_ARROW = pa.schema([
    ("id", pa.int64()), ("body", pa.int64()), ("start", pa.int32()), ("words", pa.binary()),
    ("hits", pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())]))),
])


def longest_overlap(same: np.ndarray, least: int) -> tuple[int, int]:
    """Begin and end of the longest stretch of at least ``least`` words, three quarters of them equal, the first and the last too.

    Of equally long ones that with the most matches, then the first; (0, 0) if there is none.
    """
    places = np.flatnonzero(same)
    if not len(places):
        return 0, 0
    # A prefix sum of matches less three quarters of words must not be smaller after the stretch than before it.
    gains = np.concatenate([[0], np.cumsum(np.where(same, 1 - MIN_IDENTITY, -MIN_IDENTITY))])
    lowest = np.minimum.accumulate(gains[places])
    # For each end the earliest begin from which the sum does not fall.
    first = np.searchsorted(-lowest, -gains[places + 1])
    lengths = places + 1 - places[np.minimum(first, np.arange(len(places)))]
    matches = np.arange(len(places)) + 1 - first
    fits = np.flatnonzero((lengths >= least) & (matches > 0))
    if not len(fits):
        return 0, 0
    last = fits[np.lexsort([fits, -matches[fits], -lengths[fits]])[0]]
    return int(places[first[last]]), int(places[last]) + 1


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Overlaps of documents with benchmark items, the longest of each pair.

    Returns ``id``, body (XXH64 of the text, which tells rows of one id apart), ``item``,
    first_word (in the document), n_words and n_matches. An overlap has at least 12 words
    in place, or all words of a shorter item, of which three quarters are equal after
    putting A-Z in lower case; it begins and ends with an equal word. Items of under 5
    words are ignored. Null texts have no words; null ids are rows like any other; equal
    rows give one row. ``id`` must be of an integer type. Without items or documents the
    result is empty.

    Of overlaps of 10 to 20 words that meet this rule the masks hit 0.995 or more, whichever
    words differ (0.857 of 9 words); an overlap is followed to its end. Documents meet only
    seeds that pass a bit table of bounded size, and the joins carry hits, not texts: a
    passage that very many documents hold is one hit region in each.
    """
    items = _items(benchmark, item, item_text)
    # No overlap reaches further from a hit than its item is long.
    around = max(items.agg(F.max("n")).first()[0] or 0, 1)
    longest = max(len(m) for m in MASKS)
    short = sorted(r[0] for r in items.filter(F.col("n") < longest).select("n").distinct().collect())
    shapes = patterns(short)
    seeds = _seeds(items, shapes)
    regions = _regions(docs, shapes, _filter(seeds), around, id, text)
    hits = regions.select("id", "body", "start", F.explode("hits").alias("hit")).select("id", "body", "start", "hit.*")
    lines = hits.join(seeds, "key").groupBy("id", "body", "start", "item", "n", (F.col("at") - F.col("place")).alias("shift")).agg(
        F.min("at").alias("at"), F.max("at").alias("last"))
    # Nulls of ids must meet too.
    same = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.body") == F.col("r.body")) & (F.col("l.start") == F.col("r.start"))
    regions = regions.select("id", "body", "start", "words").distinct()
    pairs = lines.alias("l").join(regions.alias("r"), same).join(
        items.select("item", F.col("n").alias("_n"), F.col("words").alias("item_words")).alias("i"),
        F.col("l.item").eqNullSafe(F.col("i.item")) & (F.col("l.n") == F.col("i._n")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = [], []
            for i, (start, shift, words, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5, 6)))):
                doc, it = np.frombuffer(words, np.uint64), np.frombuffer(own, np.uint64)
                a, b = max(shift, 0), min(shift + len(it), len(doc))
                equal = doc[a:b] == it[a - shift : b - shift]
                begin, end = longest_overlap(equal, min(MIN_WORDS, len(it)))
                matches = int(equal[begin:end].sum())
                if end > begin:
                    kept.append(i)
                    rows.append((start + a + begin, end - begin, matches))
            columns = list(zip(*rows)) or [(), (), ()]
            picked = pa.array(kept, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(picked) for c in range(3)), *(pa.array(x, pa.int32()) for x in columns)],
                ["id", "body", "item", "first_word", "n_words", "n_matches"])

    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("body", T.LongType()), items.schema["item"],
        *(T.StructField(n, T.IntegerType()) for n in ("first_word", "n_words", "n_matches"))])
    found = pairs.select("l.id", "l.body", "l.item", "l.start", "shift", "r.words", "item_words").mapInArrow(compare, schema)
    best = F.max_by(F.struct("first_word", "n_words", "n_matches"), F.struct("n_words", "n_matches", -F.col("first_word")))
    return found.groupBy("id", "body", "item").agg(best.alias("best")).select(
        F.col("id").alias(id), "body", F.col("item").alias(item), "best.*")
