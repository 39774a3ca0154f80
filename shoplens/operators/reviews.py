"""Keyword categories and lexicon sentiment of review texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.functions.grams import FEW, contained
from shoplens.functions.text import (
    NEGATIVE,
    NEUTRAL,
    POSITIVE,
    as_text,
    is_blank,
    sentiment_label,
    truncate,
)

UNCLASSIFIED = "unclassified"

Taxonomy = Sequence[tuple[str, Sequence[str]]]
Lexicon = Sequence[tuple[str, int]]
HITS = "array<struct<word:string,score:bigint>>"


# -- categories ----------------------------------------------------------------------


def category_of(text: Column, taxonomy: Taxonomy) -> Column:
    """First category, in the given order, with any keyword contained in the text."""
    first: dict[str, int] = {}
    for number, (_, keywords) in enumerate(taxonomy):
        for word in keywords:
            first.setdefault(word, number)
    if len(first) <= FEW:
        # Generated code, which stops at the first category that fits.
        result = F.when(is_blank(text), UNCLASSIFIED)
        for category, keywords in taxonomy:
            result = result.when(reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in keywords], F.lit(False)), category)
        return result.otherwise(UNCLASSIFIED)
    # Keywords in the order of their categories: the least place found is one of the first category.
    ends = list(accumulate(Counter(first.values())[n] for n in range(len(taxonomy))))
    least = F.get(contained(text, list(first)), 0)
    result = F.when(is_blank(text) | least.isNull(), UNCLASSIFIED)
    for (category, _), end in zip(taxonomy, ends):
        result = result.when(least < end, category)
    return result


def classify(df: DataFrame, text: str, taxonomy: Taxonomy) -> DataFrame:
    """Add ``category``; null, blank and unmatched texts are ``unclassified``."""
    return df.withColumn("category", category_of(as_text(text), taxonomy))


def category_distribution(df: DataFrame) -> DataFrame:
    """``(rank, category, n, pct)``, largest first, ``unclassified`` always last."""
    counts = df.groupBy("category").agg(F.count("*").alias("n"))
    # Windows over one row per category.
    order = W.orderBy((F.col("category") == UNCLASSIFIED), F.desc("n"), "category")
    return counts.select(
        F.row_number().over(order).alias("rank"),
        "category",
        "n",
        F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 2).alias("pct"),
    )


def category_examples(df: DataFrame, text: str, order_by: str, k: int = 5, length: int = 200) -> DataFrame:
    """``(category, rank, <order_by>, example)``: the first k texts of each category."""
    # Texts are cut before the window, so only the shown part is sorted and shuffled;
    # every task keeps at most k rows per category.
    shown = df.select("category", order_by, truncate(as_text(text), length, "...").alias("example"))
    first = W.partitionBy("category").orderBy(order_by)
    return shown.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select(
        "category", "rank", order_by, "example"
    )


# -- sentiment -----------------------------------------------------------------------


def lexicon_hits(text: Column, lexicon: Lexicon) -> Column:
    """``array<struct<word,score>>`` of the lexicon words contained in the text.

    Longest word first, then lexicon order. Each word counts once, and a word inside
    a longer one counts as well.
    """
    words = sorted(dict(lexicon).items(), key=lambda ws: -len(ws[0]))
    if not words:
        return F.array().cast(HITS)
    listed = F.split(F.lit("\x00".join(w for w, _ in words)), "\x00")
    scores = F.split(F.lit(",".join(str(int(s)) for _, s in words)), ",").cast("array<bigint>")
    places = contained(text, [w for w, _ in words])
    hits = F.transform(places, lambda i: F.struct(F.get(listed, i).alias("word"), F.get(scores, i).alias("score")))
    return F.when(is_blank(text), F.array().cast(HITS)).otherwise(hits)


def score_sentiment(df: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """Add ``hits``, ``score``, ``keywords`` (joined by ", ") and ``label``."""
    scored = df.withColumn("hits", lexicon_hits(as_text(text), lexicon))
    score = F.aggregate("hits", F.lit(0).cast("long"), lambda total, hit: total + hit["score"])
    return (
        scored.withColumn("score", score)
        .withColumn("keywords", F.array_join("hits.word", ", "))
        .withColumn("label", sentiment_label("score"))
    )


def label_counts(df: DataFrame, labels: Sequence[str], *extra: Column) -> DataFrame:
    """``(label, n, pct, total, ...)`` with a row for every label, zeros included, in one pass."""
    wide = df.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("label") == x).alias(x) for x in labels], *extra
    )
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("n")) for x in labels])
    others = [c for c in wide.columns if c not in labels and c != "total"]
    return wide.select("total", *others, F.inline(rows)).select(
        "label", "n", F.round(F.try_divide(F.col("n") * 100.0, F.col("total")), 2).alias("pct"), "total", *others
    )


def sentiment_distribution(df: DataFrame) -> DataFrame:
    """``(label, n, pct, total, avg_score)`` for positive, neutral and negative."""
    return label_counts(df, (POSITIVE, NEUTRAL, NEGATIVE), F.round(F.avg("score"), 4).alias("avg_score"))


def _word_counts(df: DataFrame) -> DataFrame:
    """``(word, score, n)``: documents per matched word; combined before the shuffle."""
    # inline would let the optimizer infer that hits must not be empty, and test that at the scan: matching twice.
    found = df.select(F.inline_outer("hits")).where("word IS NOT NULL")
    return found.groupBy("word", "score").agg(F.count("*").alias("n"))


def _polarity() -> Column:
    return F.when(F.col("score") > 0, POSITIVE).when(F.col("score") < 0, NEGATIVE)


def top_keywords(df: DataFrame, k: int = 5) -> DataFrame:
    """``(polarity, rank, word, n)``: the words found in most documents, per polarity."""
    counts = _word_counts(df).withColumn("polarity", _polarity()).where("polarity IS NOT NULL")
    order = W.partitionBy("polarity").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "polarity", "rank", "word", "n"
    )


def keyword_weights(df: DataFrame, max_words: int = 100) -> DataFrame:
    """``(word, score, n, band)``: the most frequent matched words with their strength."""
    score = F.col("score")
    band = (
        F.when(score >= 2, "strong_positive")
        .when(score >= 1, "positive")
        .when(score <= -2, "strong_negative")
        .when(score <= -1, "negative")
        .otherwise(NEUTRAL)
    )
    return _word_counts(df).withColumn("band", band).orderBy(F.desc("n"), "word").limit(max_words)


def strongest_keywords(df: DataFrame, k: int = 15) -> DataFrame:
    """``(polarity, rank, word, strength)``: matched words with the largest scores."""
    words = _word_counts(df).select(_polarity().alias("polarity"), "word", F.abs("score").alias("strength"))
    order = W.partitionBy("polarity").orderBy(F.desc("strength"), "word")
    return (
        words.where("polarity IS NOT NULL")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("polarity", "rank", "word", "strength")
    )


def representative_reviews(df: DataFrame, text: str, order_by: str, k: int = 5, length: int = 200) -> DataFrame:
    """``(label, rank, <order_by>, example, score, keywords)``.

    Positive from the highest score, negative from the lowest, neutral in order.
    """
    shown = df.select("label", order_by, F.substring(as_text(text), 1, length).alias("example"), "score", "keywords")
    distance = F.when(F.col("label") == NEUTRAL, F.lit(0).cast("long")).otherwise(-F.abs("score"))
    order = W.partitionBy("label").orderBy(distance, order_by)
    return shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "label", "rank", order_by, "example", "score", "keywords"
    )
