"""Corpus statistics over ``tokens array<string>``, one row per document."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.functions.text import NEGATIVE, NEUTRAL, POSITIVE, as_text, detect_language
from shoplens.operators.columns import detect_text_column
from shoplens.operators.frequent import most_frequent
from shoplens.operators.reviews import label_counts

VOCABULARY = 1000


def word_freq(tok: DataFrame, k: int | None = None, two_phase: bool = False) -> DataFrame:
    """``(word, n)``, most frequent first; the counts are combined before the shuffle.

    ``two_phase`` reads the tokens two or three times, but does not shuffle all words;
    it pays where tasks hold many distinct words. The result is the same.
    """
    words = tok.select(F.explode("tokens").alias("word"))
    if two_phase and k is not None:
        return most_frequent(words, k)
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), "word")
    return counts if k is None else ordered.limit(k)


def corpus_overview(df: DataFrame, tok: DataFrame, text: str | None = None) -> DataFrame:
    """One row ``(n_docs, n_words, text_column, language)``."""
    text = text or detect_text_column(df)
    words = word_freq(tok).agg(F.count("*").alias("n")).scalar()
    return df.agg(F.count("*").alias("n_docs")).select(
        "n_docs",
        words.alias("n_words"),
        F.lit(text).alias("text_column"),
        detect_language(df, text).scalar().alias("language"),
    )


def tfidf_keywords(tok: DataFrame, vocab: int = VOCABULARY, k: int = 20) -> DataFrame:
    """``(rank, term, score)``: mean TF-IDF over all documents, rounded to 4.

    Raw term counts, idf = ln((1 + N) / (1 + df)) + 1, every document scaled to length 1.
    A document is one vector over the vocabulary throughout; only two vectors of
    ``vocab`` numbers, the document counts and the means, leave the tasks.
    """
    spark = tok.sparkSession
    terms = [r["word"] for r in word_freq(tok, vocab).collect()]
    schema = "rank int, term string, score double"
    if not terms:
        return spark.createDataFrame([], schema)
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="tokens", outputCol="counts")
    counts = counter.transform(tok.select("tokens"))
    n_docs, holding = counts.agg(F.count("*"), Summarizer.numNonZeros(F.col("counts"))).first()
    idf = Vectors.dense([math.log((1 + n_docs) / (1 + n)) + 1 for n in holding])
    weighted = ElementwiseProduct(scalingVec=idf, inputCol="counts", outputCol="weights").transform(counts)
    scaled = Normalizer(p=2.0, inputCol="weights", outputCol="scaled").transform(weighted)
    means = scaled.agg(Summarizer.mean(F.col("scaled"))).first()[0]
    scores = spark.createDataFrame([(t, float(x)) for t, x in zip(terms, means)], "term string, score double")
    best = scores.select("term", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "term").limit(k)
    # A window over k rows.
    return best.select(F.row_number().over(W.orderBy(F.desc("score"), "term")).alias("rank"), "term", "score")


def _grams(tok: DataFrame, n: int) -> DataFrame:
    """``ngram``: adjacent tokens joined by " + "; shorter documents give none."""
    tokens, names = F.col("tokens"), [f"w{i}" for i in range(n)]
    following = [F.slice(tokens, i + 1, F.greatest(F.size(tokens), F.lit(1))) for i in range(1, n)]
    words = tok.select(F.inline(F.arrays_zip(tokens, *following))).toDF(*names)
    parts = [x for name in names for x in (F.lit(" + "), F.col(name))][1:]
    return words.select(F.concat(*parts).alias("ngram")).where("ngram IS NOT NULL")


def ngrams(tok: DataFrame, n: int = 2, k: int = 50, min_tokens: int = 0, two_phase: bool = False) -> DataFrame:
    """``(n, rank, ngram, count)``; with ``min_tokens``, empty for a corpus of fewer tokens.

    ``two_phase`` as for ``word_freq``.
    """
    total = tok.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).scalar()
    enough = total >= min_tokens if min_tokens else F.lit(True)
    grams = _grams(tok, n)
    if two_phase:
        top = most_frequent(grams, k).withColumnRenamed("n", "count")
    else:
        top = grams.groupBy("ngram").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "ngram").limit(k)
    top = top.where(enough)
    # A window over k rows.
    rank = F.row_number().over(W.orderBy(F.desc("count"), "ngram"))
    return top.select(F.lit(n).alias("n"), rank.alias("rank"), "ngram", "count")


def cooccurrence(tok: DataFrame, top_n: int = 20, min_count: int = 2) -> DataFrame:
    """``(w1, w2, weight)``: documents holding both words, for the ``top_n`` most frequent words.

    Documents are first reduced to their set of top words (collected: ``top_n`` words)
    and equal sets are counted together; pairs are formed from the distinct sets only.
    """
    top = F.array(*[F.lit(r["word"]) for r in word_freq(tok, top_n).collect()]).cast("array<string>")
    sets = (
        tok.select(F.sort_array(F.array_intersect("tokens", top)).alias("words"))
        .where(F.size("words") > 1)
        .groupBy("words")
        .agg(F.count("*").alias("n"))
    )
    pairs = F.flatten(
        F.transform("words", lambda a, i: F.transform(
            F.slice(F.col("words"), i + 2, F.size("words")),
            lambda b: F.struct(a.alias("w1"), b.alias("w2"))))
    )
    return (
        sets.select("n", F.inline(pairs))
        .groupBy("w1", "w2")
        .agg(F.sum("n").alias("weight"))
        .where(F.col("weight") >= min_count)
    )


def token_sentiment_distribution(df: DataFrame) -> DataFrame:
    """``(label, n, pct, total)`` over the labels of ``token_sentiment``."""
    return label_counts(df, (POSITIVE, NEGATIVE, NEUTRAL))


def token_sentiment_examples(df: DataFrame, text: str, order_by: str, k: int = 3, length: int = 120) -> DataFrame:
    """``(label, rank, <order_by>, example)``: first k positive and negative documents."""
    shown = df.where(F.col("label") != NEUTRAL).select(
        "label", order_by, F.substring(as_text(text), 1, length).alias("example")
    )
    first = W.partitionBy("label").orderBy(order_by)
    return shown.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select(
        "label", "rank", order_by, "example"
    )


def cloud_weights(freq: DataFrame, lexicon: Sequence[tuple[str, int]], max_words: int = 100) -> DataFrame:
    """``(word, n, polarity)``: the most frequent words with their lexicon sign."""
    def scored(test) -> list[str]:
        return [w for w, s in dict(lexicon).items() if test(s)]

    word = F.col("word")
    polarity = (
        F.when(word.isin(scored(lambda s: s > 0)), POSITIVE)
        .when(word.isin(scored(lambda s: s < 0)), NEGATIVE)
        .otherwise(NEUTRAL)
    )
    return freq.orderBy(F.desc("n"), "word").limit(max_words).select("word", "n", polarity.alias("polarity"))
