"""LDA topics by online variational Bayes: Spark draws the documents of a step, tasks infer many documents at once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.operators.mining import VOCABULARY, word_freq
from shoplens.session import reuse

PART = 0.5
PASSES = 20
OFFSET, DECAY = 10.0, 0.7

# Shape of the random starts; a document is done when its weights change by less on average; cells inferred at once.
_SHAPE = 100.0
_CHANGE = 1e-3
_CELLS = 1 << 15
_DRAWS = 16  # nobody is drawn more often


@dataclass
class Topics:
    weights: np.ndarray  # of the topics' Dirichlet distributions over words, k rows
    vectors: DataFrame
    vocabulary: list[str]
    k: int
    seed: int


def _exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)) by recurrence to x + 6 and a series in x + 5.5; of relative error below 1e-9."""
    p, y = x * (x + 5), x + 5.5
    r = 1 / (y * y)
    series = y * (1 + r * (1 / 24 - r * (37 / 5760 - r * (10313 / 2903040 - r * (5509121 / 1393459200)))))
    return series * np.exp((-2 * x - 5) * (1 / p + 1 / (p + 4) + 1 / (p + 6)))


def _expected(weights: np.ndarray) -> np.ndarray:
    """exp(E[log p]) of Dirichlet distributions along the first axis."""
    return _exp_digamma(weights) / _exp_digamma(weights.sum(axis=0))


def infer(shares: np.ndarray, sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of documents and exp(E[log p]) of them, k rows each.

    ``shares``: exp(E[log p]) of the words, k rows; ``words`` and ``counts``: those of all documents, of which
    ``sizes`` says how many belong to each; ``start``: weights to begin with. Every document is followed until
    it changes by less than ``_CHANGE``, whichever documents are beside it; those that take long meet again.
    """
    now, theta = start.copy(), _expected(start)
    first = np.cumsum(sizes) - sizes
    waiting = np.argsort(sizes, kind="stable")
    waiting = waiting[sizes[waiting] > 0]
    now[:, sizes == 0] = 1.0 / len(shares)
    while len(waiting):
        left, begin = [], 0
        last = sizes[waiting].sum() <= _CELLS
        while begin < len(waiting):
            # Documents of like size fill a rectangle; the rest of it counts nothing.
            wide = sizes[waiting[begin : begin + _CELLS]]
            fits = np.flatnonzero(wide * np.arange(1, len(wide) + 1) <= _CELLS)
            rows = waiting[begin : begin + 1 + (fits[-1] if len(fits) else 0)]
            begin += len(rows)
            left.append(_followed(shares, *_rectangle(sizes[rows], first[rows], words, counts), rows, now, theta, last))
        waiting = np.concatenate(left)
    return now, theta


def _rectangle(sizes: np.ndarray, first: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts of some documents, a column each."""
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    source, column = place + np.repeat(first, sizes), np.repeat(np.arange(len(sizes)), sizes)
    own, amounts = np.zeros((sizes.max(), len(sizes)), np.int64), np.zeros((sizes.max(), len(sizes)))
    own[place, column], amounts[place, column] = words[source], counts[source]
    return own, amounts


def _followed(
    shares: np.ndarray, words: np.ndarray, counts: np.ndarray, rows: np.ndarray, now: np.ndarray, theta: np.ndarray, to_end: bool
) -> np.ndarray:
    """Renew columns ``rows`` of ``now`` and ``theta``; returns the few that are not done yet, none with ``to_end``."""
    prior, known, stop = 1.0 / len(shares), shares.take(words, 1), 0 if to_end else len(rows) // 8
    weights, parts, busy = now[:, rows], theta[:, rows], np.ones(len(rows), bool)
    # From the first round on the weights of a document add up to its words and the priors.
    whole = _exp_digamma(counts.sum(axis=0) + 1.0)
    while busy.sum() > stop:
        norm = np.einsum("kwd,kd->wd", known, parts)
        norm += 1e-100
        np.divide(counts, norm, out=norm)
        new = parts * np.einsum("kwd,wd->kd", known, norm) + prior
        new_parts = _exp_digamma(new) / whole
        change = np.abs(new - weights).mean(axis=0)
        weights, parts = np.where(busy, new, weights), np.where(busy, new_parts, parts)
        busy &= change > _CHANGE
        if 2 * busy.sum() < len(busy):
            now[:, rows], theta[:, rows] = weights, parts
            kept = np.flatnonzero(busy)
            known, counts = known.take(kept, 2), counts.take(kept, 1)
            rows, weights, parts, busy, whole = rows[kept], weights.take(kept, 1), parts.take(kept, 1), busy[kept], whole[kept]
    now[:, rows], theta[:, rows] = weights, parts
    return rows[busy]


def word_shares(
    shares: np.ndarray, sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, theta: np.ndarray, times: np.ndarray
) -> np.ndarray:
    """How much of every word goes to every topic, k rows, each document counted ``times``."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    known = shares.take(words, 1)
    whole = counts * times[owner] / ((known * theta.take(owner, 1)).sum(axis=0) + 1e-100)
    return shares * np.stack([np.bincount(words, x[owner] * whole, shares.shape[1]) for x in theta])


def _arrays(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, words and counts of sparse vectors."""
    indices, values = vectors.field("indices"), vectors.field("values")
    return np.diff(indices.offsets.to_numpy()), indices.flatten().to_numpy(), values.flatten().to_numpy()


def _start(k: int, n: int, *seeds: int) -> np.ndarray:
    return np.random.default_rng(seeds).gamma(_SHAPE, 1 / _SHAPE, (n, k)).T.copy()


def _times(part: float, seed: int) -> Column:
    """How often a row is drawn: Poisson numbers of mean ``part``, which is a draw with replacement."""
    sums = np.cumsum([math.exp(-part) * part**i / math.factorial(i) for i in range(_DRAWS)])
    drawn = F.rand(seed)
    return F.aggregate(F.array(*map(F.lit, sums.tolist())), F.struct(drawn.alias("u"), F.lit(0).alias("n")),
                       lambda s, x: F.struct(s["u"].alias("u"), (s["n"] + (s["u"] >= x).cast("int")).alias("n")), lambda s: s["n"])


def _step(drawn: DataFrame, shares: np.ndarray, *seeds: int) -> np.ndarray:
    """Word shares of the drawn documents: a task sends one sum of k times the vocabulary."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = np.zeros_like(shares), TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            own = _arrays(batch.column(0))
            _, theta = infer(shares, *own, _start(len(shares), batch.num_rows, *seeds, task, number))
            total += word_shares(shares, *own, theta, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["shares"])

    rows = drawn.mapInArrow(summed, "shares binary").collect()
    return sum((np.frombuffer(r[0]).reshape(shares.shape) for r in rows), np.zeros_like(shares))


def fit_topics(
    tok: DataFrame,
    id: str,
    k: int = 5,
    seed: int = 42,
    vocab: int = VOCABULARY,
    passes: int = PASSES,
    part: float = PART,
) -> Topics:
    """Online variational Bayes with priors 1/K, offset 10, decay 0.7.

    Every step draws a random ``part`` of the documents, with replacement, so a document
    is read ``passes`` times on average, in ``passes / part`` steps at any corpus size.
    A document that a step draws more than once is inferred once and counted so often.
    The vectors are kept for the fit and for ``topic_share``; ``session.release`` frees them.
    """
    words = [r["word"] for r in word_freq(tok, vocab).collect()]
    n_docs = tok.count()
    k = min(k, n_docs, len(words))
    if k < 2:
        raise ValueError("not enough data for topics")
    counted = CountVectorizerModel.from_vocabulary(words, inputCol="tokens", outputCol="features")
    vectors = reuse(counted.transform(tok.select(id, "tokens")).select(id, "features"))
    # Without steps, Spark's LDA returns the random weights that it begins with.
    weights = LDA(k=k, optimizer="online", maxIter=0, seed=seed).fit(vectors).topicsMatrix().toArray().T
    draws = Random(seed)
    for step in range(1, math.ceil(passes / part) + 1):
        drawn = vectors.select("features", _times(part, draws.getrandbits(62)).alias("times")).where("times > 0")
        found = _step(drawn, _expected(weights.T).T, seed, step)
        if found.any():
            rate = (OFFSET + step) ** -DECAY
            weights = (1 - rate) * weights + rate * (found * (n_docs / math.ceil(part * n_docs)) + 1.0 / k)
    return Topics(weights, vectors, words, k, seed)


def lda_topics(topics: Topics, words: int = 10) -> DataFrame:
    """``(topic, rank, word)``, topics from 1."""
    best = np.argsort(-topics.weights, axis=1, kind="stable")[:, :words].tolist()
    rows = [(t, r, topics.vocabulary[w]) for t, own in enumerate(best, 1) for r, w in enumerate(own, 1)]
    return topics.vectors.sparkSession.createDataFrame(rows, "topic int, rank int, word string")


def lda_doc_topics(topics: Topics, id: str) -> DataFrame:
    """``(<id>, topic)``: the strongest topic; a document without known words gets topic 1."""
    shares, seed = _expected(topics.weights.T).T, topics.seed
    schema = T.StructType([topics.vectors.schema[id], T.StructField("topic", T.IntegerType())])

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            weights, _ = infer(shares, *_arrays(batch.column(1)), _start(len(shares), batch.num_rows, seed, 0, task, number))
            topic = pa.array(weights.argmax(axis=0) + 1, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), topic], schema.names)

    return topics.vectors.select(id, "features").mapInArrow(strongest, schema)


def topic_share(topics: Topics, id: str) -> DataFrame:
    """``(topic, n, pct)`` with a row for every topic."""
    wide = lda_doc_topics(topics, id).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("topic") == t).alias(f"t{t}") for t in range(1, topics.k + 1)],
    )
    rows = F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"t{t}").alias("n")) for t in range(1, topics.k + 1)])
    return wide.select("total", F.inline(rows)).select(
        "topic", "n", F.round(F.try_divide(F.col("n") * 100.0, F.col("total")), 2).alias("pct")
    )
