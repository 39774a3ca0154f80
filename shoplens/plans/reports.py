"""The five analyses: one input table in, named result tables out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.operators import eda, graph, mining, rfm, sales, topics
from shoplens.operators import reviews as rv
from shoplens.operators.columns import PROFILE_SCHEMA, detect_text_column, profile, resolve_roles
from shoplens.functions.text import detect_language
from shoplens.functions.words import NOUN_TAGS
from shoplens.operators.tokens import token_sentiment, tokenize, vector_terms
from shoplens.session import reuse

DIMENSIONS = ("time", "customer", "product")
TEXT_ANALYSES = ("tfidf", "lda", "network", "wordcloud", "sentiment")


def analyze_categories(df: DataFrame, id: str, taxonomy: rv.Taxonomy, text: str | None = None) -> dict[str, DataFrame]:
    text = text or detect_text_column(df)
    classified = rv.classify(df, text, taxonomy)
    return {
        "rows": classified,
        "distribution": rv.category_distribution(classified),
        "examples": rv.category_examples(classified, text, id),
    }


def analyze_sentiment(df: DataFrame, id: str, lexicon: rv.Lexicon, text: str | None = None) -> dict[str, DataFrame]:
    text = text or detect_text_column(df)
    scored = rv.score_sentiment(df, text, lexicon)
    # The tables share the scored rows; they are written once, with the shown part of the text.
    shared = reuse(scored.select(id, F.substring(text, 1, 200).alias(text), "hits", "score", "keywords", "label"))
    return {
        "rows": scored.drop("hits").select(*df.columns, "label", "score", "keywords"),
        "distribution": rv.sentiment_distribution(shared),
        "keyword_weights": rv.keyword_weights(shared),
        "top_keywords": rv.top_keywords(shared),
        "strongest_keywords": rv.strongest_keywords(shared),
        "representatives": rv.representative_reviews(shared, text, id),
    }


def analyze_table(df: DataFrame, order_by: str) -> dict[str, DataFrame]:
    """Distinct values are counted once and quartiles found once for all tables."""
    profiled = df.sparkSession.createDataFrame(profile(df).collect(), PROFILE_SCHEMA)  # one row per column
    roles = {r["column"]: r["role"] for r in profiled.collect()}
    numeric = [c for c in df.columns if roles[c] == "numeric"]
    result = {
        "rows": df,
        "overview": eda.overview(df, roles),
        "profile": profiled,
        "top_values": eda.top_values(df, eda.widest_categorical(df, profiled)),
        "missing": eda.missing_summary(df, profiled),
        "daily_counts": eda.daily_counts(df, [c for c in df.columns if roles[c] == "datetime"]),
    }
    if numeric:
        known = eda.quartiles(df, numeric)
        result |= {
            "describe": eda.describe(df, numeric, known),
            "histogram": eda.histogram(df),
            "outliers": eda.iqr_outliers(df, numeric, known),
            "outlier_examples": eda.outlier_examples(df, order_by, numeric, known=known),
            "box_stats": eda.box_stats(df, numeric, known),
        }
    if len(numeric) > 1:
        result["correlation"] = eda.correlation(df, numeric)
    return result


def analyze_sales(
    df: DataFrame,
    col_map: Mapping[str, str] | None = None,
    dimensions: Sequence[str] = DIMENSIONS,
) -> dict[str, DataFrame]:
    """Key figures plus the tables of the chosen dimensions.

    The cleaned sales are written once, restricted to the columns the tables read.
    Without "customer" there are no RFM tables; without "product" (or a product
    column) no product tables.
    """
    cleaned = sales.clean_sales(df, resolve_roles(df.columns, col_map))
    needed = ["order_date", "customer", "product", "quantity", "price", "revenue"]
    s = sales.require_rows(reuse(cleaned.select(*[c for c in needed if c in cleaned.columns])))
    result = {"kpis": sales.sales_kpis(s)}
    if "time" in dimensions:
        result |= {
            "monthly_revenue": sales.monthly_revenue(s),
            "daily_orders": sales.daily_orders(s),
            "weekday_orders": sales.weekday_orders(s),
        }
    if "product" in dimensions and "product" in s.columns:
        result |= {
            "top_products_revenue": sales.top_products(s, "revenue"),
            "top_products_quantity": sales.top_products(s, "quantity"),
        }
    if "customer" in dimensions:
        scored = reuse(rfm.rfm_segments(s))
        result |= {
            "rfm": scored,
            "segment_distribution": rfm.segment_distribution(scored),
            "segment_scores": rfm.segment_scores(scored),
            "segment_summary": rfm.segment_summary(scored),
            "findings": rfm.sales_findings(scored),
        }
    return result


def analyze_text(
    df: DataFrame,
    id: str,
    text: str | None = None,
    lang: str | None = None,
    analyses: Sequence[str] = TEXT_ANALYSES,
    n_topics: int = 5,
    top_n: int = 20,
    stopwords: Sequence[str] = (),
    lexicon: rv.Lexicon = (),
    lemmas: DataFrame | None = None,
    analyzer: Callable | None = None,
    pos_tags: Sequence[str] = NOUN_TAGS,
) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Result tables and ``(part, message)`` for parts that failed; the others still run.

    A part that fails only when its table is computed is kept apart by ``save_results(..., isolate=True)``.
    The tokens are kept for all parts; ``session.release`` frees them once the tables are written.
    """
    text = text or detect_text_column(df)
    lang = lang or detect_language(df, text).first()["language"]
    shown = F.substring(text, 1, 120).alias(text)
    tokens = tokenize(df.select(id, text), text, lang, stopwords, lemmas, analyzer, pos_tags)
    tok = reuse(tokens.select(id, shown, "tokens"))
    # English words are terms as they are; forms of an analyzer or a lemma table may not be.
    terms = tok if lang == "en" and lemmas is None else reuse(vector_terms(tok.select(id, "tokens")))
    result = {
        "word_freq": mining.word_freq(tok),
        "overview": mining.corpus_overview(df, tok, text),
    }
    errors: list[tuple[str, str]] = []

    def part(name: str, build: Callable[[], dict[str, DataFrame]]) -> None:
        try:
            result.update(build())
        except Exception as error:
            errors.append((name, str(error)))

    def lda() -> dict[str, DataFrame]:
        fitted = topics.fit_topics(terms, id, n_topics)
        return {
            "topics": topics.lda_topics(fitted),
            "doc_topics": topics.lda_doc_topics(fitted, id),
            "topic_share": topics.topic_share(fitted, id),
        }

    def network() -> dict[str, DataFrame]:
        return {"edges": mining.cooccurrence(tok, top_n), "network": graph.keyword_network(tok, top_n)}

    def sentiment() -> dict[str, DataFrame]:
        if not lexicon:
            raise ValueError("no sentiment lexicon given")
        scored = token_sentiment(tok, lexicon)
        return {
            "sentiment_cloud": mining.cloud_weights(mining.word_freq(tok), lexicon),
            "sentiment_distribution": mining.token_sentiment_distribution(scored),
            "sentiment_examples": mining.token_sentiment_examples(scored, text, id),
        }

    builders = {
        "tfidf": lambda: {"tfidf": mining.tfidf_keywords(terms, k=top_n)},
        "lda": lda,
        "network": network,
        "wordcloud": lambda: {"cloud": mining.cloud_weights(mining.word_freq(tok), ())},
        "sentiment": sentiment,
    }
    part("ngrams", lambda: {"bigrams": mining.ngrams(tok, 2), "trigrams": mining.ngrams(tok, 3)})
    for name in TEXT_ANALYSES:
        if name in analyses:
            part(name, builders[name])
    return result, errors
