"""From texts to arrays of tokens, one row per document throughout."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.text import as_text, sign_label
from shoplens.functions.words import ENGLISH_STOPWORDS, NOUN_TAGS

MAX_LEMMAS = 1_000_000

# Runs of characters that form a word where no analyzer is given.
CHINESE_RUN = r"[\x{4e00}-\x{9fff}]{2,}"
JAPANESE_RUN = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}]{2,}"

# Fixed value: what counts as a term of a weight or topic.
TERM = r"[\p{L}\p{N}_]{2,}"


def _without(tokens: Column, words: Sequence[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(list(words))) if words else tokens


def english_words(text: Column, dropped: Sequence[str] = ()) -> Column:
    """Runs of three and more Latin letters, in lower case."""
    def kept(t: Column) -> Column:
        return (F.length(t) >= 3) & ~t.isin(list(dropped)) if dropped else F.length(t) >= 3

    return F.filter(F.split(F.lower(text), "[^a-z]+"), kept)


def analyzed_words(tagged: Column, pos_tags: Sequence[str] | None, min_len: int) -> Column:
    """Forms of ``array<struct<form,tag>>`` with a wanted tag and length."""
    kept = F.filter(tagged, lambda m: F.length(m["form"]) >= min_len)
    if pos_tags is not None:
        kept = F.filter(kept, lambda m: m["tag"].isin(list(pos_tags)))
    return F.transform(kept, lambda m: m["form"])


def lemmatize(df: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace tokens by ``lemma`` of the table ``(token, lemma)``; unknown ones stay.

    Of several lemmas of a token the first by name counts. The table goes to every
    worker, so more than MAX_LEMMAS tokens are an error; the texts stay where they are,
    and the step is legal on a stream.
    """
    table = lemmas.where("token IS NOT NULL AND lemma IS NOT NULL").groupBy("token").agg(F.min("lemma").alias("lemma"))
    rows = table.limit(MAX_LEMMAS + 1).collect()
    if len(rows) > MAX_LEMMAS:
        raise ValueError(f"a lemma table has at most {MAX_LEMMAS} tokens")
    known = df.sparkSession.sparkContext.broadcast(dict(map(tuple, rows)))

    @F.pandas_udf("array<string>")
    def replaced(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda found: None if found is None else [known.value.get(t, t) for t in found])

    return df.withColumn("tokens", replaced("tokens"))


def tokenize(
    df: DataFrame,
    text: str,
    lang: str = "en",
    stopwords: Sequence[str] = (),
    lemmas: DataFrame | None = None,
    analyzer: Callable[[Column], Column] | None = None,
    pos_tags: Sequence[str] = NOUN_TAGS,
) -> DataFrame:
    """Add ``tokens array<string>``.

    ``analyzer`` maps the text column to ``array<struct<form,tag>>`` (for example an
    Arrow-batched pandas UDF around a morphological analyzer). It is required for
    Korean and replaces the character runs used for Chinese and Japanese. ``lemmas``
    is a table ``(token, lemma)`` for English.
    """
    body = as_text(text)
    if lang == "ko":
        if analyzer is None:
            raise ValueError("Korean texts need an analyzer")
        tokens = _without(analyzed_words(analyzer(body), pos_tags, 2), stopwords)
    elif lang in ("zh", "ja"):
        if analyzer is not None:
            tokens = analyzed_words(analyzer(body), None, 2)
        else:
            run = CHINESE_RUN if lang == "zh" else JAPANESE_RUN
            tokens = F.regexp_extract_all(body, F.lit(run), F.lit(0))
        tokens = _without(tokens, stopwords)
    else:
        dropped = [*ENGLISH_STOPWORDS, *stopwords]
        if lemmas is None:
            tokens = english_words(body, dropped)
        else:
            df = lemmatize(df.withColumn("tokens", english_words(body)), lemmas)
            tokens = _without(F.col("tokens"), dropped)
    return df.withColumn("tokens", tokens)


def vector_terms(df: DataFrame) -> DataFrame:
    """``df`` with the ``tokens`` that weights and topics count: lower-case runs of two and more letters, digits and "_".

    A token with other characters inside becomes several; a mark that is no letter ends a
    run. English tokens without lemmas are such runs already. Row-local; null stays null.
    """
    joined = F.lower(F.array_join("tokens", " "))
    return df.withColumn("tokens", F.regexp_extract_all(joined, F.lit(TERM), F.lit(0)))


def filter_tokens(
    tokens: DataFrame,
    pos_tags: Sequence[str] = NOUN_TAGS,
    min_len: int = 2,
    stopwords: Sequence[str] = (),
) -> DataFrame:
    """Wanted rows of a tagged-token table ``(doc_id, pos, form, tag)``."""
    kept = tokens.where(F.col("tag").isin(list(pos_tags)) & (F.length("form") >= min_len))
    return kept.where(~F.col("form").isin(list(stopwords))) if stopwords else kept


def token_sentiment(df: DataFrame, lexicon: Sequence[tuple[str, int]]) -> DataFrame:
    """Add ``score`` (every occurrence of a lexicon token counts) and ``label``; row-local."""
    scores = dict(lexicon)
    pairs = [F.lit(x) for w, s in scores.items() for x in (w, int(s))]
    known = F.filter("tokens", lambda t: t.isin(list(scores)))
    score = F.aggregate(
        known, F.lit(0).cast("long"), lambda total, t: total + F.create_map(*pairs)[t].cast("long")
    )
    return df.withColumn("score", score).withColumn("label", sign_label("score"))
