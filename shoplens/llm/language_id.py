"""Language identification with error-correcting output codes over byte n-grams.

Every language has a codeword; for each bit a binary classifier compares the languages
whose bit is 1 with the others by the log-odds of a text's byte n-grams. The language
whose codeword has the smallest total logistic loss against the classifiers' outputs is
chosen, so a wrong bit is outvoted by the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.llm.store import packed, unpacked
from shoplens.llm.words import mix, slices, text_bytes

SAMPLE_PER_LANGUAGE = 2000  # training rows of each language, about
ORDERS = (2, 3, 4)
BINS = 1 << 16
SMOOTHING = 0.5
EVIDENCE = 30.0  # a text counts like so many n-grams, whatever its length
AMBIGUOUS = 0.6  # a lower score leaves the language open
UNKNOWN = "und"
_TASKS = 8

# A-Z in lower case, other ASCII as white space, bytes of other letters as they are.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def codewords(languages: int) -> np.ndarray:
    """Rows of +1 and -1, a column per bit: all ways to part few languages, seeded random ones for many."""
    if languages <= 7:
        columns = [(1, *x) for x in product((1, -1), repeat=languages - 1) if -1 in x]
        return np.array(columns, np.float64).reshape(-1, languages).T
    length = 10 * int(np.ceil(np.log2(languages)))
    return np.random.Generator(np.random.PCG64(10)).choice([1.0, -1.0], (languages, length))


def ngram_bins(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every n-gram of all texts, and the text of each; runs of other bytes count as one space."""
    data, starts = text_bytes(texts)
    line = _CLASS[data]
    keep = np.concatenate([[True], (line[1:] != 32) | (line[:-1] != 32)]) if len(line) else np.zeros(0, bool)
    keep[starts[:-1]] = True
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[keep]
    line = line[keep].astype(np.uint64)
    bins, owners = [], []
    for order in ORDERS:
        if len(line) >= order:
            code = np.full(len(line) - order + 1, order, np.uint64)
            for i in range(order):
                code = (code << np.uint64(8)) | line[i : len(line) - order + 1 + i]
            whole = owner[: len(code)] == owner[order - 1 :]
            bins.append((mix(code[whole]) & np.uint64(BINS - 1)).astype(np.int32))
            owners.append(owner[: len(code)][whole])
    if not bins:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(bins), np.concatenate(owners)


@dataclass
class Codes:
    """A fitted model: log-odds of each bin for each bit."""

    languages: list[str]
    odds: np.ndarray  # bins x bits

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the chosen language and its share of certainty, for every text."""
        bins, owner = ngram_bins(texts)
        n, bits = len(texts), self.odds.shape[1]
        found = np.bincount(owner, minlength=n)
        outputs = np.stack([np.bincount(owner, self.odds[bins, b], n) for b in range(bits)], axis=1) if bits else np.zeros((n, 0))
        outputs *= (EVIDENCE / np.maximum(found, 1))[:, None]
        loss = np.logaddexp(0, -outputs[:, None, :] * codewords(len(self.languages))[None]).mean(axis=2) * 4 if bits else np.zeros((n, 1))
        weight = np.exp(loss.min(axis=1, keepdims=True) - loss)
        best = loss.argmin(axis=1)
        return best, weight[np.arange(n), best] / weight.sum(axis=1)


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_PER_LANGUAGE) -> Codes:
    """Fit on about ``rows`` documents of each language, drawn by a hash of id and text; their texts are read whole.

    Of a language with fewer documents all are taken. Rows with a null or empty text or a
    null language are left out. Only counts and the chosen texts are moved.
    """
    known = docs.filter(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(id, text).alias("place"))
    # One row per language: the share of all hashes that holds about the wanted rows.
    shares = known.groupBy("lang").agg((F.lit(rows) / F.count("*")).alias("share"))
    chosen = (F.col("place") / 2.0**64 + 0.5) <= F.col("share")
    sample = known.join(F.broadcast(shares), "lang").filter(chosen).select("lang", "text").repartition(_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for few in slices(batch, 1, 1 << 18):
                bins, owner = ngram_bins(few.column(1))
                names = np.array(few.column(0).to_pylist(), object)
                for name in set(names):
                    own = np.bincount(bins[(names == name)[owner]], minlength=BINS)
                    totals[name] = totals.get(name, 0) + own
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals)), pa.array([x.astype("<i8").tobytes() for x in totals.values()], pa.binary())],
                ["lang", "counts"])

    totals: dict[str, np.ndarray] = {}
    # A row per task and language: the sample is bounded, so few tasks are enough.
    for row in sample.mapInArrow(count, "lang string, counts binary").collect():
        totals[row.lang] = totals.get(row.lang, 0) + np.frombuffer(row.counts, "<i8")
    languages = sorted(totals)
    if not languages:
        return Codes([], np.zeros((BINS, 0)))
    shares = np.stack([(totals[x] + SMOOTHING) / (totals[x].sum() + SMOOTHING * BINS) for x in languages])
    codes = codewords(len(languages))
    odds = [np.log(shares[bit > 0].mean(axis=0)) - np.log(shares[bit < 0].mean(axis=0)) for bit in codes.T]
    return Codes(languages, np.array(odds).reshape(-1, BINS).T)


def predict(docs: DataFrame, codes: Codes, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """All columns with ``<prefix>pred``, ``<prefix>score`` (0 to 1) and ``<prefix>ambiguous``.

    A null text, one without a letter, or any text if no language was learned is ``und``
    with score 0 and is ambiguous. Only the text is used. Columns of ``docs`` with the
    three names are replaced.
    """
    names = [f"{prefix}{x}" for x in ("pred", "score", "ambiguous")]
    if not codes.languages:
        return docs.withColumns(dict(zip(names, (F.lit(UNKNOWN), F.lit(0.0), F.lit(True)))))
    model = docs.sparkSession.sparkContext.broadcast(codes)  # bounded: bins times bits
    value = F.col(text).cast("string")
    # A text travels once, within its row, unless it must be cast.
    place = docs.columns.index(text) if docs.columns.count(text) == 1 and docs.schema[text].dataType == T.StringType() else None
    own = {} if place is not None else {"text": value}
    rows = packed(docs, letter=F.coalesce(value.rlike(r"\p{L}"), F.lit(False)), **own)
    schema = T.StructType([rows.schema["row"], T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2) if place is None else pc.struct_field(batch.column(0), place)
            batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["row", "letter", "text"])
            for few in slices(batch, 2, 1 << 18):
                best, score = model.value.decide(few.column(2))
                letter = few.column(1).to_numpy(zero_copy_only=False)
                pred = np.where(letter, np.array(model.value.languages, object)[best], UNKNOWN)
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array(pred, pa.string()), pa.array(np.where(letter, score, 0.0))], schema.names)

    found = (F.col("pred"), F.col("score"), F.col("score") < AMBIGUOUS)
    return unpacked(rows.mapInArrow(decide, schema), docs, **dict(zip(names, found)))


def training_rows(id: Column, folds: int = 5) -> Column:
    """Whether a row is not held out; a null id counts as an empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % folds != 0


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out and predict all rows.

    Returns ``id``, held_out, lang_pred, score and ambiguous. Each row gives one row; an
    empty table gives an empty result.
    """
    codes = fit(docs.filter(training_rows(F.col(id))), id, text, lang)
    found = predict(docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")), codes)
    return found.select(F.col("id").alias(id), (~training_rows(F.col("id"))).alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
