"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, mapped into memory for scoring.

Words are counted first, by 64-bit hashes, and numbered about by their frequency. A task then
counts the n-grams of its texts in arrays and sends them, already summed, to shards; a shard
merges its blocks into a sorted array of contexts and, for each, the numbers and counts of the
words that follow, written to the shared folder, and passes its continuation counts on to the
next lower order. An n-gram's shard follows from its context, so that what a context needs (its
total, and how many continuations have counts 1, 2 and more) is summed where its n-grams are;
contexts that hold much of the corpus are dealt out by the last word too, and their sums are
added up afterwards. Workers map the arrays and look up batches.
"""

from __future__ import annotations

import os
import pickle
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.llm.store import mounted, new_folder, remove, shuffles_dropped, small_batches, written
from shoplens.llm.words import mix, slices, word_hashes

ORDER = 3
SHARD_BYTES = 16 << 20  # training text per shard
BLOCK_GRAMS = 2_000_000  # n-grams a task sums up before it sends them
END, BEGIN = (mix(np.array([x], np.uint64))[0] for x in (1, 2))
BEGIN_NUMBER, UNKNOWN, FIRST_NUMBER = range(3)  # words are numbered from FIRST_NUMBER
STEP = 4  # contexts for each place of their continuations that is kept
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_BLOCKS = "shard int, kind string, data binary"


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of word hashes; none for no columns."""
    total = np.zeros(len(columns[0]) if columns else 0, np.uint64)
    for words in columns:
        total = mix(total * _FACTOR + words)
    return total


def lines(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, where each n-gram ends and its text; a text begins with ``order - 1`` marks and has an end."""
    hashes, _, _, before = word_hashes(texts)
    lengths = np.diff(before)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    line = np.full(len(hashes) + order * len(lengths), BEGIN, np.uint64)
    line[np.arange(len(hashes)) + owner * order + order - 1] = hashes
    line[before[1:] + np.arange(len(lengths)) * order + order - 1] = END
    owners = np.repeat(np.arange(len(lengths)), lengths + 1)
    return line, np.arange(len(owners)) + (owners + 1) * (order - 1), owners


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and the place of each value among them."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def dealt(places: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash; it grows with the hash."""
    return ((places >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def by_shard(places: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each shard by ascending hash."""
    order = np.argsort(places)
    shard = dealt(places[order], shards)
    edges = np.flatnonzero(shard[1:] != shard[:-1]) + 1
    for rows in np.split(order, edges) if len(order) else ():
        yield int(dealt(places[rows[:1]], shards)[0]), rows


def summed(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted distinct n-gram hashes, their words and their summed counts (1 each if not given)."""
    keys = gram_hash(columns)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        totals = np.diff(first, append=len(keys)).astype(np.uint64)
    else:
        totals = np.add.reduceat(counts[order], first) if len(first) else counts
    return keys[first], [c[order[first]] for c in columns], totals


@dataclass
class Placing:
    """The shard of an n-gram of numbers."""

    shards: int
    heavy: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of contexts

    def shard(self, columns: list[np.ndarray]) -> np.ndarray:
        if len(columns) == 1:
            return ((columns[0] - columns[0].dtype.type(FIRST_NUMBER)) % columns[0].dtype.type(self.shards)).astype(np.int64)
        return dealt(self.place(gram_hash(columns[:-1]), columns[-1]), self.shards).astype(np.int64)

    def place(self, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The hash by which an n-gram is dealt: its context's, or that of both where the context is heavy."""
        heavy = np.flatnonzero(self.is_heavy(context))
        if not len(heavy):
            return context
        out = context.copy()
        out[heavy] = mix(context[heavy] * _FACTOR + last[heavy])
        return out

    def is_heavy(self, context: np.ndarray) -> np.ndarray:
        if not len(self.heavy):
            return np.zeros(len(context), bool)
        at = np.minimum(np.searchsorted(self.heavy, context), len(self.heavy) - 1)
        return self.heavy[at] == context


class HashPlacing(Placing):
    """The shard of a word's hash."""

    def shard(self, columns: list[np.ndarray]) -> np.ndarray:
        return dealt(columns[0], self.shards).astype(np.int64)


class Words:
    """Numbers and counts of words by their hashes, from the arrays of the first count, mapped into memory."""

    def __init__(self, path: Path, shards: int, limit: int):
        self.path, self.shards = path, shards
        self.type = np.uint32 if limit <= 1 << 32 else np.uint64
        self.array = lru_cache(maxsize=4096)(lambda name: _mapped(path / f"words-{name}.npy"))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers, counts = np.full(len(hashes), UNKNOWN, self.type), np.zeros(len(hashes), np.uint64)
        for shard, rows in by_shard(hashes, self.shards):
            known = self.array(f"{shard}-keys")
            if known is None:
                continue
            sought = hashes[rows]
            at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
            hit = known[at] == sought
            rows, at = rows[hit], at[hit]
            numbers[rows] = self.array(f"{shard}-ranks")[at].astype(np.uint64) * np.uint64(self.shards) + np.uint64(shard + FIRST_NUMBER)
            counts[rows] = self.array(f"{shard}-counts")[at]
        numbers[hashes == BEGIN] = BEGIN_NUMBER
        return numbers, counts


def _planes(values: np.ndarray) -> bytes:
    """Width and bytes of unsigned integers, all first bytes first, which makes them small once compressed."""
    narrow = _narrow(values)
    width = narrow.dtype.itemsize
    return bytes([width]) + np.ascontiguousarray(narrow.view(np.uint8).reshape(-1, width).T).tobytes()


def _block(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """N-grams and their counts, compressed; sorted by their first two words, of the first of which the steps are kept.

    Numbers of words are small where they are frequent, so that most bytes are zero. Hashes
    become places in a list of words, the most frequent first, for the same reason.
    """
    words = np.zeros(0, np.uint64)
    if max(c.max(initial=0) for c in columns) < 1 << 32:
        ranks = np.stack(columns).astype(np.int64)
    else:
        words, places, often = np.unique(np.concatenate(columns), return_inverse=True, return_counts=True)
        by = np.argsort(-often, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[by] = np.arange(len(words))
        ranks, words = rank[places].reshape(len(columns), -1), words[by]
    order = np.argsort(ranks[0] << 32 | ranks[min(1, len(ranks) - 1)])
    ranks = ranks[:, order]
    ranks[0] = np.diff(ranks[0], prepend=0)
    head = np.array([len(words), len(counts)], "<u8").tobytes() + words.astype("<u8").tobytes()
    raw = head + b"".join(map(_planes, [*ranks.astype(np.uint64), counts[order]]))
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unblock(data: bytes, order: int) -> list[np.ndarray]:
    """The columns of the n-grams, and their counts."""
    raw = np.frombuffer(pa.decompress(data[8:], struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True), np.uint8)
    known, n = raw[:16].view("<u8").tolist()
    words, at, rows = raw[16 : 16 + 8 * known].view("<u8"), 16 + 8 * known, []
    for _ in range(order + 1):
        width = int(raw[at])
        planes = raw[at + 1 : at + 1 + width * n].reshape(width, n)
        rows.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += 1 + width * n
    rows[0] = np.cumsum(rows[0], dtype=np.uint64)
    return [*(words[x] if known else x.astype(np.uint32) for x in rows[:-1]), rows[-1].astype(np.uint64)]


def _packed(columns: list[np.ndarray], counts: np.ndarray, placing: Placing) -> Iterator[tuple[int, bytes]]:
    """Blocks of n-grams by shard."""
    shard = placing.shard(columns)
    order = np.argsort(shard.astype(np.min_scalar_type(placing.shards)), kind="stable")
    shard = shard[order]
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
    for begin, end in zip(edges, [*edges[1:], len(shard)]):
        rows = order[begin:end]
        yield int(shard[begin]), _block([c[rows] for c in columns], counts[rows])


def _unpacked(blocks: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    *columns, counts = map(np.concatenate, zip(*(_unblock(x, order) for x in blocks)))
    return columns, counts


def _batch(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())],
        ["shard", "kind", "data"])


def _counted(texts: DataFrame, order: int, placing: Placing, folder: Path | None = None, limit: int = 0) -> DataFrame:
    """Blocks of n-grams of the numbers in ``folder``, or of hashes if there is none."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(folder, placing.shards, limit) if folder else None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            starts = np.cumsum([0, *(len(line) for line, _ in held)])
            line, last = np.concatenate([x for x, _ in held]), np.concatenate([y + at for (_, y), at in zip(held, starts)])
            held.clear()
            if words:
                hashes, places = distinct(line)
                line = words.find(hashes)[0][places]
            _, columns, counts = summed([line[last - order + 1 + j] for j in range(order)])
            for shard, data in _packed(columns, counts, placing):
                yield _batch([(shard, "grams", data)])

        for batch in batches:
            for few in slices(batch, 0):
                held.append(lines(few.column(0), order)[:2])
                size += len(held[-1][1])
                if size >= BLOCK_GRAMS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return texts.mapInArrow(count, _BLOCKS)


def _save(path: Path, array: np.ndarray) -> None:
    """Write whole or not at all: a repeated task replaces the file by an equal one."""
    part = path.with_name(f"{path.name}.{os.getpid()}.part")
    with open(part, "wb") as file:
        np.save(file, array)
    os.replace(part, path)


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(counts.max())) if len(counts) else counts.astype(np.uint8)


def _mapped(file: Path) -> np.ndarray | None:
    return np.asarray(np.load(file, mmap_mode="r")) if file.exists() else None


def _facts(shard: int, counts: np.ndarray) -> tuple[int, str, bytes]:
    sums = np.array([len(counts), counts.sum(), *((counts == i).sum() for i in (1, 2, 3, 4))], np.uint64)
    return shard, "sums", sums.tobytes()


def _merge_words(table: pa.Table, folder: Path) -> pa.Table:
    """Write a shard's words by their hashes, their counts and their ranks by count."""
    shard = table.column("shard")[0].as_py()
    _, (words,), counts = summed(*_unpacked(table.column("data").to_pylist(), 1))
    by = np.argsort(words)
    words, counts = words[by].astype(np.uint64), counts[by]
    ranks = np.empty(len(words), np.uint64)
    ranks[np.argsort(counts, kind="stable")[::-1]] = np.arange(len(words))
    for kind, array in (("keys", words), ("counts", _narrow(counts)), ("ranks", _narrow(ranks))):
        _save(folder / f"words-{shard}-{kind}.npy", array)
    return pa.Table.from_batches([_batch([_facts(shard, counts)])])


def _merge_grams(table: pa.Table, level: int, folder: Path, placing: Placing) -> pa.Table:
    """Write a shard's arrays of one order; returns its sums and the blocks of the next lower order."""
    shard = table.column("shard")[0].as_py()
    columns, counts = _unpacked(table.column("data").to_pylist(), level)
    if level == 1:
        at = (columns[0] - columns[0].dtype.type(FIRST_NUMBER)) // columns[0].dtype.type(placing.shards)
        dense = np.zeros(int(at.max()) + 1, np.uint64)
        np.add.at(dense, at, counts)
        _save(folder / f"order1-{shard}-counts.npy", _narrow(dense))
        return pa.Table.from_batches([_batch([_facts(shard, dense[dense > 0])])])
    # N-grams in order of context and last word.
    context = gram_hash(columns[:-1])
    order = np.argsort(context)
    context = context[order]
    number = np.cumsum(np.concatenate([[False], context[1:] != context[:-1]]), dtype=np.uint64)
    last = columns[-1][order]
    key = number * (np.uint64(last.max()) + np.uint64(1)) + last
    by = np.argsort(key, kind="stable")
    key, order = key[by], order[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts, order = np.add.reduceat(counts[order], first), order[first]
    context, number, columns = context[first], number[first], [c[order] for c in columns]
    begins = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    stats = np.stack([np.add.reduceat(x.astype(np.uint64), begins) for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1)
    context = context[begins]
    heavy = placing.is_heavy(context)
    # Few contexts need more than a byte a number; they are kept apart.
    wide = heavy | (stats.max(axis=1) > 255)
    runs = np.diff(begins, append=len(counts))
    for kind, kept in (("", ~wide), ("wide", wide)):
        own = np.repeat(kept, runs)
        arrays = {"contexts": context[kept], "stats": _narrow(stats[kept]), "words": columns[-1][own], "counts": _narrow(counts[own]),
                  "places": _narrow((np.cumsum(runs[kept]) - runs[kept])[:: 1 if kind else STEP])}
        for name, array in arrays.items():
            _save(folder / f"order{level}-{shard}-{kind}{name}.npy", array)
    rows = [_facts(shard, counts)]
    if heavy.any():
        rows.append((shard, "heavy", np.column_stack([context, stats])[heavy].tobytes()))
    # What begins a text has no word on its left to be counted by.
    _, shorter, ones = summed(columns[1:], np.where(columns[1] == BEGIN_NUMBER, counts, 1).astype(counts.dtype))
    rows += [(s, "grams", data) for s, data in _packed(shorter, ones, placing)]
    return pa.Table.from_batches([_batch(rows)])


def _sums(rows: DataFrame) -> tuple[list[int], int]:
    """Distinct n-grams, their total, and how many have counts 1 to 4; and the most in a shard: one short row per shard comes to the driver."""
    found = [np.frombuffer(r.data, np.uint64) for r in rows.filter("kind = 'sums'").select("data").collect()]
    return (np.sum(found, axis=0, dtype=np.uint64).tolist(), int(max(x[0] for x in found))) if found else ([0] * 6, 0)


def _discounts(sums: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and more.

    Where one would not lie strictly between 0 and its count, as in tables too small or full
    of copies, all are half of their count: every context then leaves something to unseen words.
    """
    n1, n2, n3, n4 = sums[2:]
    out = [0.0]
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        out += [i - (i + 1) * y * b / a for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    return out if len(out) == 4 and all(0 < d < i for i, d in enumerate(out[1:], 1)) else [0.0, 0.5, 1.0, 1.5]


def train(texts: DataFrame, text: str, folder: str, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> None:
    """Count the model of ``texts`` and write it to ``folder``; no count is pruned.

    A null text is an empty text; each text has an end, which is counted as a word.
    Memory is bounded by a shard of ``shard_bytes`` of text. A context is heavy if its
    count exceeds an eighth of a shard's share: at most eight times as many as shards.
    """
    path = mounted(folder)
    path.mkdir(parents=True, exist_ok=True)
    bodies = texts.select(F.col(text).cast("string").alias("text"))
    size = bodies.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    spark = texts.sparkSession

    def merged(blocks: DataFrame, name: str, *args) -> DataFrame:
        merge = _merge_words if name == "words" else _merge_grams
        rows = blocks.groupBy("shard").applyInArrow(lambda table: merge(table, *args), _BLOCKS)
        rows.write.parquet(f"{folder}/blocks-{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/blocks-{name}")

    total, most = _sums(merged(_counted(bodies, 1, HashPlacing(shards)), "words", path))
    limit = FIRST_NUMBER + most * shards
    placing = Placing(shards, _heavy(bodies, path, shards, total[1]))
    meta = {"order": order, "placing": placing, "words": total, "limit": limit, "levels": {}}
    blocks = _counted(bodies, order, placing, path, limit)
    for level in range(order, 0, -1):
        rows = merged(blocks, f"order{level}", level, path, placing)
        remove(spark, f"{folder}/blocks-order{level + 1}")
        sums, _ = _sums(rows)
        meta["levels"][level] = {"sums": sums, "discounts": _discounts(sums)}
        parts = [np.frombuffer(r.data, np.uint64).reshape(-1, 5)
                 for r in rows.filter("kind = 'heavy'").select("data").collect()] if level > 1 else []
        meta["levels"][level]["heavy"] = _added(np.concatenate(parts)) if parts else None
        blocks = rows.filter("kind = 'grams'")
    for name in ("words", "order1"):
        remove(spark, f"{folder}/blocks-{name}")
    part = path / "model.part"
    part.write_bytes(pickle.dumps(meta))
    os.replace(part, path / "model")


def _heavy(bodies: DataFrame, path: Path, shards: int, total: int) -> np.ndarray:
    """Hashes of the one-word contexts with more than an eighth of a shard's share, and of the beginning.

    There are at most eight times as many as shards. Longer contexts are rarer still.
    """
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                ranks, counts = (_mapped(path / f"words-{shard}-{kind}.npy") for kind in ("ranks", "counts"))
                if ranks is not None:
                    found = ranks[counts > total // (8 * shards)].astype(np.uint64) * np.uint64(shards) + np.uint64(shard + FIRST_NUMBER)
                    yield pa.RecordBatch.from_arrays([pa.array(gram_hash([found]).view(np.int64))], ["context"])

    rows = bodies.sparkSession.range(shards).mapInArrow(frequent, "context long").collect()
    return np.sort(np.concatenate([gram_hash([np.array([BEGIN_NUMBER], np.uint64)]), np.array([r[0] for r in rows], np.int64).view(np.uint64)]))


def _added(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(rows[:, 0], return_inverse=True)
    stats = np.zeros((len(keys), 4), np.uint64)
    np.add.at(stats, at, rows[:, 1:])
    return keys, stats


def _run(four: np.ndarray) -> np.ndarray:
    """How many words follow a context whose sums are four bytes: all but the first, the total, are numbers of words."""
    return (four >> 8 & 255) + (four >> 16 & 255) + (four >> 24)


class Model:
    """A written model, its arrays mapped into memory as they are used."""

    def __init__(self, folder: str):
        self.path = mounted(folder)
        meta = pickle.loads((self.path / "model").read_bytes())
        self.order, self.placing, self.words, self.levels = meta["order"], meta["placing"], meta["words"], meta["levels"]
        self.numbers = Words(self.path, self.placing.shards, meta["limit"])
        self.array = lru_cache(maxsize=4096)(lambda name: _mapped(self.path / f"{name}.npy"))

    def single(self, numbers: np.ndarray) -> np.ndarray:
        """Continuation counts of words."""
        out = np.zeros(len(numbers), np.uint64)
        known = np.flatnonzero(numbers >= FIRST_NUMBER)
        places = (numbers[known] - FIRST_NUMBER).astype(np.uint64)
        shard, at = places % np.uint64(self.placing.shards), (places // np.uint64(self.placing.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
            counts = self.array(f"order1-{shard[rows[0]]}-counts")
            if counts is not None:
                rows = rows[at[rows] < len(counts)]
                out[known[rows]] = counts[at[rows]]
        return out

    def after(self, level: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of n-grams; and of their contexts the total and numbers of continuations with counts 1, 2, more."""
        context, last = gram_hash(columns[:-1]), columns[-1]
        counts, stats = np.zeros(len(last), np.uint64), np.zeros((len(last), 4), np.uint64)
        for shard, rows in by_shard(self.placing.place(context, last), self.placing.shards):
            for kind in ("", "wide"):
                known = self.array(f"order{level}-{shard}-{kind}contexts")
                if known is None or not len(known):
                    continue
                sought = context[rows]
                at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
                hit = known[at] == sought
                found, at = rows[hit], at[hit]
                stats[found], counts[found] = self._following(f"order{level}-{shard}-{kind}", at, last[found])
                rows = rows[~hit]
        if self.levels[level]["heavy"] is not None:
            keys, added = self.levels[level]["heavy"]
            at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
            hit = keys[at] == context
            stats[hit] = added[at[hit]]
        return counts, stats

    def _following(self, name: str, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the contexts at places ``at``, and the counts of the words ``last`` after them."""
        stats, words, counts, places = (self.array(f"{name}{kind}") for kind in ("stats", "words", "counts", "places"))
        own = stats[at]
        if len(places) == len(stats):
            low = places[at].astype(np.int64)
            high = low + own[:, 1:].sum(axis=1, dtype=np.int64)
        else:
            # A byte a number: a context's words begin after those of the contexts before it, counted from the kept place.
            four = stats.reshape(-1).view("<u4")
            low = places[at // STEP].astype(np.int64)
            for back in range(1, STEP):
                rows = np.flatnonzero(at % STEP >= back)
                low[rows] += _run(four[at[rows] - back])
            high = low + _run(four[at])
        ends = high.copy()
        rows = np.arange(len(at))
        while len(rows):  # the first place whose word is not below the sought one
            middle = (low[rows] + high[rows]) >> 1
            below = words[middle] < last[rows]
            low[rows[below]] = middle[below] + 1
            high[rows[~below]] = middle[~below]
            rows = rows[low[rows] < high[rows]]
        found = np.zeros(len(at), np.uint64)
        inside = np.flatnonzero(low < ends)
        inside = inside[words[low[inside]] == last[inside]]
        found[inside] = counts[low[inside]]
        return own, found

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of the last word of each n-gram of hashes after the others."""
        hashes, places = distinct(np.concatenate(columns))
        numbers = self.numbers.find(hashes)[0]
        return self.chances(numbers, places.reshape(len(columns), -1))

    def chances(self, numbers: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of the last word of each n-gram after the others, given as places in an array of distinct numbers."""
        distinct_words, total, *few = self.levels[1]["sums"]
        out = np.full(len(numbers), 1.0 / (distinct_words + 1))
        stats = np.array([[total, *few[:2], distinct_words - few[0] - few[1]]], np.float64)
        out = self._mixed(1, self.single(numbers), stats, out)[places[-1]]
        for level in range(2, self.order + 1):
            counts, stats = self.after(level, [numbers[x] for x in places[-level:]])
            out = self._mixed(level, counts, stats.astype(np.float64), out)
        return out

    def _mixed(self, level: int, counts: np.ndarray, stats: np.ndarray, lower: np.ndarray) -> np.ndarray:
        discounts = np.array(self.levels[level]["discounts"])
        total = np.maximum(stats[:, 0], 1)
        free = stats[:, 1:] @ discounts[1:] / total
        used = (counts - discounts[np.minimum(counts, 3).astype(np.int64)]) / total
        return np.where(stats[:, 0] > 0, used + free * lower, lower)


@lru_cache(maxsize=2)
def _model(folder: str) -> Model:
    return Model(folder)


def score(docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every row under the model in ``folder``.

    Returns ``id``, n_tokens (with the end), n_known (seen in training), train_tokens,
    base_score (log10 probability under add-0.1 word frequencies) and score (log10
    probability under the model). A null text is an empty text: the end alone.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), *(
        T.StructField(n, t()) for n, t in (("n_tokens", T.LongType), ("n_known", T.LongType), ("train_tokens", T.LongType),
                                           ("base_score", T.DoubleType), ("score", T.DoubleType)))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(folder)
        known, total = model.words[:2]
        for batch in batches:
            for few in slices(batch, 1):
                line, last, owner = lines(few.column(1), model.order)
                hashes, places = distinct(line)
                numbers, seen = model.numbers.find(hashes)
                base = np.log10((seen + 0.1) / (total + 0.1 * (known + 1)))
                own = np.log10(model.chances(numbers, places[np.arange(1 - model.order, 1)[:, None] + last]))
                n, words = few.num_rows, places[last]
                yield pa.RecordBatch.from_arrays([
                    few.column(0), pa.array(np.bincount(owner, minlength=n)),
                    pa.array(np.bincount(owner, (seen > 0)[words], n).astype(np.int64)), pa.array(np.full(n, total)),
                    pa.array(np.bincount(owner, base[words], n)), pa.array(np.bincount(owner, own, n)),
                ], schema.names)

    scored = docs.select(docs[id], docs[text].cast("string")).mapInArrow(rows, schema)
    return scored.toDF(id, *schema.names[1:])


def held_out(id: Column, folds: int = 10) -> Column:
    """Whether a row's remainder is 0; a null id counts as an empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def score_held_out(docs: DataFrame, order: int = ORDER, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows that are not held out and score all rows: ``score`` with held_out.

    Repeated rows count as often as they occur. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "language-model")
    with small_batches(spark), shuffles_dropped(spark):
        train(docs.filter(~held_out(F.col(id))), text, folder, order)
        result = written(score(docs, folder, id, text).withColumn("held_out", held_out(F.col(id))), "scores")
    remove(spark, folder)
    return result
