"""BPE encoding by dynamic programming over prefixes, and decoding.

A byte-pair encoding of a word is settled prefix by prefix: of all tokens that end at a
position exactly one is the last token of the prefix's encoding, namely the one that is
compatible with the last token of the prefix before it. An automaton over the vocabulary
follows suffix links to list the tokens ending at each position, longest first; a memo
of pair tests decides; back-pointers then give the ids. No merge loop runs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from shoplens.llm.words import slices

END = "</w>"
_NEVER = 1 << 30
# Word ends are marked on the last symbol, so that a symbol is one character.
_END_SHIFT = 0x1000
CACHED_CHUNKS = 400_000  # in each of two generations per worker; what it forgets is encoded again
CACHED_LENGTH = 64
_LATIN_ENDS = "\u024f"
# White space of the tokenizer's pattern; str.split() would also cut at these four separators.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
SPACES = regex.compile(r"[^\S\x1c-\x1f]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def chunks_of(text: str) -> list[str]:
    """Stretches between white space; words never cross it."""
    return [x for x in SPACES.split(text) if x] if SEPARATORS.search(text) else text.split()


class PrefixBpe:
    """A vocabulary file of the tokenizers library, of the kind with word ends and byte symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError(f"{path}: a BPE vocabulary with the word end {END} is needed")
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.tokens = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for token, number in [*model["vocab"].items(), *self.special.items()]:
            self.tokens[number] = token
        self.symbol_of_byte = dict(enumerate(byte_symbols()))
        self._read_merges(model)
        self.pair_memo: dict[tuple[int, int], bool] = {}
        self.cache = Recent(self.chunk)

    def _read_merges(self, model: dict) -> None:
        ids = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.rank: dict[tuple[int, int], int] = {}
        # For each token, its outer symbols while it grows and the rank of the merge that ends each.
        self.right = {i: [(i, _NEVER)] for i in ids.values()}
        self.left = {i: [(i, _NEVER)] for i in ids.values()}
        reachable = set(ids.values())
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        products = []
        for rank, (a, b) in enumerate(pairs):
            first, second, product = ids[a], ids[b], ids[a + b]
            self.rank[first, second] = rank
            self.right[product] = [*self.right[second][:-1], (second, rank), (product, _NEVER)]
            self.left[product] = [*self.left[first][:-1], (first, rank), (product, _NEVER)]
            products.append((first, second, product))
        for first, second, product in products:
            # A token whose own text is encoded otherwise is never the result of encoding.
            if not {first, second} <= reachable or self._meeting(first, second) != (first, second):
                reachable.discard(product)
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}
        for token, number in ids.items():
            if number in reachable and token != END:
                word = self._marked(token.removesuffix(END)) if token.endswith(END) else token
                self.whole[word] = number
                self.automaton.add_word(word, (len(word), number))
        self.automaton.make_automaton()

    @staticmethod
    def _marked(symbols: str) -> str:
        return symbols[:-1] + chr(ord(symbols[-1]) + _END_SHIFT)

    def _meeting(self, first: int, second: int) -> tuple[int, int] | None:
        """The two symbols that would merge across the border of two neighbours, or None."""
        right, left, i, j = self.right[first], self.left[second], 0, 0
        while True:
            (a, a_ends), (b, b_ends) = right[i], left[j]
            rank = self.rank.get((a, b), _NEVER)
            # Of equal merges the one further left comes first.
            if rank < a_ends and (rank < b_ends or rank == b_ends < _NEVER):
                return a, b
            if a_ends == b_ends == _NEVER:
                return None
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def word(self, word: str) -> list[int]:
        """Ids of one word of byte symbols with its end marked."""
        if word in self.whole:
            return [self.whole[word]]
        last: list[int | None] = [None] * (len(word) + 1)
        start = [0] * (len(word) + 1)
        memo = self.pair_memo
        for end, (length, token) in self.automaton.iter(word):
            if last[end + 1] is None:
                begin = end + 1 - length
                if begin:
                    pair = (last[begin], token)
                    fits = memo.get(pair)
                    if fits is None:
                        if len(memo) > 2_000_000:
                            memo.clear()
                        fits = memo[pair] = self._meeting(*pair) is None
                    if not fits:
                        continue
                last[end + 1], start[end + 1] = token, begin
        ids, end = [], len(word)
        while end:
            ids.append(last[end])
            end = start[end]
        return ids[::-1]

    def chunk(self, chunk: str) -> bytes:
        """Ids of a stretch without white space, as little-endian unsigned 32-bit integers."""
        if max(chunk) > _LATIN_ENDS:
            # Other scripts take the letter classes of the library's Unicode version.
            text = self.library.normalizer.normalize_str(chunk)
            pieces = [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        else:
            text = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)).lower()
            pieces = [
                x if x.isascii() and x.isprintable() else x.encode("utf-8").decode("latin-1").translate(self.symbol_of_byte)
                for x in self.pattern.findall(text)
            ]
        ids = []
        for piece in pieces:
            ids += self.word(self._marked(piece))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers; special tokens in the text are found."""
        if "<|" not in text:
            return b"".join(map(self.cache.__getitem__, chunks_of(text)))
        parts = []
        for part in self.special_pattern.split(text):
            number = self.special.get(part)
            parts.append(self.encode_plain(part) if number is None else np.array([number], "<u4").tobytes())
        return b"".join(parts)

    def encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, chunks_of(text)))

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids joined by a space, as the vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Recent(dict):
    """Values of ``make``, of which the most recently used are kept: lookups are those of a dict."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, chunk: str) -> bytes:
        value = self.older.get(chunk)
        if value is None:
            value = self.make(chunk)
        self.keep(chunk, value)
        return value

    def unknown(self, chunks: set[str]) -> list[str]:
        return [c for c in chunks if c not in self and c not in self.older and len(c) <= CACHED_LENGTH]

    def keep_all(self, chunks: list[str], values: Iterable[bytes]) -> None:
        """Many short chunks at once."""
        if len(self) >= CACHED_CHUNKS:
            self.older = dict(self)
            self.clear()
        self.update(zip(chunks, values))

    def keep(self, chunk: str, value: bytes) -> None:
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHED_CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = value


@lru_cache(maxsize=2)
def bpe_of(path: str) -> PrefixBpe:
    """The vocabulary, built once per worker."""
    return PrefixBpe(path)


def encode_decode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every row's text and decode the ids again.

    Returns ``id``, ids (binary, little-endian unsigned 32-bit integers) and decoded.
    A null text is an empty text, which has no ids and decodes to an empty text. Each
    row gives one row, repeated ones too; nothing is shuffled. ``path`` is a file of the
    tokenizers library that every executor can read.
    """
    schema = T.StructType([docs.schema[id], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path)
        for batch in batches:
            for few in slices(batch, 1):
                ids = [bpe.encode(x or "") for x in few.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())],
                    ["id", "ids", "decoded"])

    return docs.select(docs[id], docs[text].cast("string")).mapInArrow(encode, _renamed(schema)).toDF(*schema.names)


def _renamed(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("id", schema[0].dataType), *schema[1:]])


def digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode_decode`` with n_tokens and SHA-256 digests instead of ids and text.

    The digests are taken where the ids are, so that only they leave the worker.
    """
    schema = T.StructType([
        docs.schema[id], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                             hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), *(pa.array(x, pa.string()) for x in columns[1:])],
                ["id", *schema.names[1:]])

    return docs.select(docs[id], docs[text].cast("string")).mapInArrow(encode, _renamed(schema)).toDF(*schema.names)
