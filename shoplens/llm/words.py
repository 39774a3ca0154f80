"""Hashes of the words of a batch of texts, without an object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Odd multipliers of the hashes; the table gives each byte value a random 64-bit number.
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_POWERS_CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


_UP = _powers(_FACTOR, _POWERS_CHUNK)
_DOWN = _powers(_INVERSE, _POWERS_CHUNK)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``limit`` bytes of the text in ``column``, at least a row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, nulls empty, each followed by a line feed, and where each text begins; with the end."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    whole = pc.binary_join_element_wise(filled, *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word; white space is the space and bytes 9 to 13."""
    space = np.ones(len(data) + 2, bool)
    # Below 9 the difference wraps around to high values.
    np.logical_or(data == 32, data - np.uint8(9) < 5, out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of all words, A-Z in lower case, and for each text the number of words before it; with the total."""
    data, starts = text_bytes(texts)
    begin, end = word_bounds(data)
    # sum(byte[i] * f**i) over a word, divided by f**begin; prefix sums are taken modulo 2**64.
    table = _BYTE[_LOWER]
    hashes = np.zeros(len(begin), np.uint64)
    position, word = 0, 0
    while word < len(begin):
        position = begin[word]
        last = max(word + 1, int(np.searchsorted(end, position + _POWERS_CHUNK, "right")))
        part = data[position : end[last - 1]]
        if len(part) > _POWERS_CHUNK:  # one word longer than the table of powers
            hashes[word] = _long_word(part)
        else:
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * _UP[: len(part)], out=sums[1:])
            b, e = begin[word:last] - position, end[word:last] - position
            hashes[word:last] = (sums[e] - sums[b]) * _DOWN[np.minimum(b, _POWERS_CHUNK - 1)]
        word = last
    counts = np.searchsorted(begin, starts)
    return mix(hashes), begin, end, counts


def _long_word(part: np.ndarray) -> np.uint64:
    table, total, scale = _BYTE[_LOWER], 0, 1
    for i in range(0, len(part), _POWERS_CHUNK):
        piece = part[i : i + _POWERS_CHUNK]
        total += int((table[piece] * _UP[: len(piece)]).sum(dtype=np.uint64)) * scale
        scale = scale * pow(_FACTOR, _POWERS_CHUNK, 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


def one_hash(word: str) -> int:
    """The hash of one word."""
    return int(word_hashes(pa.array([word], pa.string()))[0][0])
