"""One entry per operator: ``(spark, folder) -> DataFrame`` over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.parameters import CHINESE, EXTRA_STOPWORDS, JAPANESE, LATIN, LEXICON, TAXONOMY, TOKEN_LEXICON, TURNS
from shoplens.functions.coercion import calendar
from shoplens.functions.text import language_of, strip_html
from shoplens.functions.words import NOUN_TAGS
from shoplens.operators import columns, context, eda, graph, mining, rfm, sales, topics
from shoplens.operators import reviews as rv
from shoplens.operators import tokens as tk
from shoplens.operators.quantiles import quantile_sketches
from shoplens.plans.views import load_table, purchases_view, raw_sales, sales_view, spread
from shoplens.session import reuse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "documents")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    return spread(documents(spark, folder).select("doc_id", "text"), "doc_id")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with missing values, of which the test tables have none: errors carry
    no value, events above 80 no type.
    """
    value = F.when(F.col("event_type") != "error", F.col("value"))
    kind = F.when(F.col("value") <= 80, F.col("event_type"))
    return load_table(spark, folder, "events").withColumns({"value": value, "event_type": kind})


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "lineitem")


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tk.tokenize(reviews(spark, folder), "text", stopwords=EXTRA_STOPWORDS).select("doc_id", "text", "tokens")


def tokens_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens for operators that read them more than once."""
    return reuse(tokens(spark, folder).drop("text"))


# -- typing and roles ----------------------------------------------------------------


@query
def text_column_stats(spark, folder):
    stats = columns.text_column_stats(documents(spark, folder))
    return stats.withColumn("avg_len", F.round("avg_len", 3))


@query
def column_types(spark, folder):
    return columns.column_types(documents(spark, folder))


@query
def commerce_roles(spark, folder):
    return columns.commerce_roles(raw_sales(spark, folder))


# -- scalar operators ----------------------------------------------------------------


@query
def classify_reviews(spark, folder):
    return rv.classify(reviews(spark, folder), "text", TAXONOMY).select("doc_id", "category")


@query
def sentiment_scores(spark, folder):
    scored = rv.score_sentiment(reviews(spark, folder), "text", LEXICON)
    return scored.select("doc_id", "score", "keywords")


@query
def sentiment_labels(spark, folder):
    return rv.score_sentiment(reviews(spark, folder), "text", LEXICON).select("doc_id", "label")


@query
def doc_language(spark, folder):
    return reviews(spark, folder).select("doc_id", language_of("text").alias("language"))


@query
def tokenize_en(spark, folder):
    tok = tokens(spark, folder)
    return tok.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query
def vector_terms(spark, folder):
    """Terms of tokens with capitals, joined words and single letters."""
    pieces = F.split(F.translate(F.replace("text", F.lit("er "), F.lit("-")), "aeiou", "AEIOU"), " ")
    terms = tk.vector_terms(reviews(spark, folder).select("doc_id", pieces.alias("tokens")))
    return terms.select("doc_id", F.size("tokens").alias("n_terms"), F.array_join("tokens", " ").alias("terms"))


@query
def token_sentiment(spark, folder):
    return tk.token_sentiment(tokens(spark, folder), TOKEN_LEXICON).select("doc_id", "score", "label")


@query
def strip_html_pages(spark, folder):
    return load_table(spark, folder, "pages").select("page_id", strip_html("html").alias("text"))


@query
def clean_sales(spark, folder):
    """Sales typed as text, with unreadable, missing and negative cells."""
    lines = spread(load_table(spark, folder, "lineitem"), "l_orderkey")
    orders = load_table(spark, folder, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    quantity = F.when(F.col("l_returnflag") == "R", "-1").otherwise(F.col("l_quantity").cast("int").cast("string"))
    raw = joined.select(
        F.col("l_orderkey").alias("line_of"),
        F.col("l_linenumber").alias("line_no"),
        F.when(F.col("l_linestatus") == "F", F.date_format("l_shipdate", "yyyy/MM/dd HH:mm"))
        .when(F.col("l_tax") < 0.02, "not a date")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("InvoiceDate"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("CustomerID"),
        F.when(F.col("l_discount") == 0.01, "two").otherwise(quantity).alias("Quantity"),
        F.when(F.col("l_discount") != 0.02, F.col("l_extendedprice")).alias("UnitPrice"),
    )
    cleaned = sales.clean_sales(raw, columns.resolve_roles(raw.columns))
    return cleaned.select(
        "line_of", "line_no", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"),
        "customer", "quantity", "price", F.round("revenue", 2).alias("revenue"),
    )


@query
def calendar_parts(spark, folder):
    parts = calendar(load_table(spark, folder, "events"), "ts")
    return parts.select("event_id", "month", F.col("day").cast("string").alias("day"), "weekday")


# -- reviews -------------------------------------------------------------------------


def classified(spark, folder):
    return rv.classify(reviews(spark, folder), "text", TAXONOMY)


def scored(spark, folder):
    return rv.score_sentiment(reviews(spark, folder), "text", LEXICON)


@query
def category_distribution(spark, folder):
    return rv.category_distribution(classified(spark, folder))


@query
def category_examples(spark, folder):
    return rv.category_examples(classified(spark, folder), "text", "doc_id")


@query
def sentiment_distribution(spark, folder):
    return rv.sentiment_distribution(scored(spark, folder))


@query
def top_keywords(spark, folder):
    return rv.top_keywords(scored(spark, folder))


@query
def keyword_weights(spark, folder):
    return rv.keyword_weights(scored(spark, folder))


@query
def strongest_keywords(spark, folder):
    return rv.strongest_keywords(scored(spark, folder))


@query
def representative_reviews(spark, folder):
    return rv.representative_reviews(scored(spark, folder), "text", "doc_id")


# -- exploratory statistics ----------------------------------------------------------


@query
def eda_overview(spark, folder):
    return eda.overview(events(spark, folder))


@query
def eda_overview_repeats(spark, folder):
    # Without keys many rows repeat.
    return eda.overview(events(spark, folder).drop("event_id", "ts", "value"))


@query
def eda_profile(spark, folder):
    return columns.profile(events(spark, folder))


@query
def eda_describe(spark, folder):
    return eda.describe(events(spark, folder))


@query
def eda_describe_lineitem(spark, folder):
    return eda.describe(lineitem(spark, folder))


@query
def quartiles_of_parts(spark, folder):
    """Quartiles of all line items, bracketed by one sketch per ship year and column."""
    lines = lineitem(spark, folder)
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    sketches = quantile_sketches(lines.withColumn("year", F.year("l_shipdate")), numbers, ["year"])
    known = eda.quartiles(lines, numbers, sketches)
    table = spark.createDataFrame([(c, *q) for c, q in known.items()], "column string, q1 double, median double, q3 double")
    return table.select("column", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")])


@query
def top_variance(spark, folder):
    return eda.top_variance(lineitem(spark, folder))


@query
def histogram(spark, folder):
    return eda.histogram(lineitem(spark, folder))


@query
def top_values(spark, folder):
    return eda.top_values(load_table(spark, folder, "orders"))


@query
def daily_counts(spark, folder):
    days = eda.daily_counts(load_table(spark, folder, "orders"))
    return days.withColumn("day", F.col("day").cast("string"))


@query
def correlation(spark, folder):
    return eda.correlation(lineitem(spark, folder))


@query
def iqr_outliers(spark, folder):
    return eda.iqr_outliers(events(spark, folder))


@query
def outlier_examples(spark, folder):
    return eda.outlier_examples(events(spark, folder), "event_id")


@query
def missing_summary(spark, folder):
    return eda.missing_summary(events(spark, folder))


@query
def box_stats(spark, folder):
    return eda.box_stats(events(spark, folder))


# -- sales ---------------------------------------------------------------------------


@query
def sales_kpis(spark, folder):
    kpis = sales.sales_kpis(sales_view(spark, folder))
    return kpis.withColumns({c: F.col(c).cast("string") for c in ("date_min", "date_max")})


@query
def monthly_revenue(spark, folder):
    return sales.monthly_revenue(sales_view(spark, folder))


@query
def daily_orders(spark, folder):
    return sales.daily_orders(sales_view(spark, folder)).withColumn("day", F.col("day").cast("string"))


@query
def weekday_orders(spark, folder):
    return sales.weekday_orders(sales_view(spark, folder))


@query
def top_products_revenue(spark, folder):
    return sales.top_products(sales_view(spark, folder), "revenue")


@query
def top_products_quantity(spark, folder):
    return sales.top_products(sales_view(spark, folder), "quantity")


@query
def rfm_base(spark, folder):
    return rfm.rfm_base(sales_view(spark, folder)).withColumn("M", F.round("M", 2))


@query
def rfm_scores(spark, folder):
    return rfm.rfm_scores(sales_view(spark, folder)).drop("M")


@query
def rfm_scores_purchases(spark, folder):
    """Recency has equal edges here, so the ranks are cut."""
    return rfm.rfm_scores(purchases_view(spark, folder)).drop("M")


@query
def rfm_segments(spark, folder):
    return rfm.rfm_segments(purchases_view(spark, folder)).select("customer", "segment")


def segmented(spark, folder):
    return reuse(rfm.rfm_segments(sales_view(spark, folder)))


@query
def segment_distribution(spark, folder):
    return rfm.segment_distribution(segmented(spark, folder))


@query
def segment_scores(spark, folder):
    return rfm.segment_scores(segmented(spark, folder))


@query
def segment_summary(spark, folder):
    return rfm.segment_summary(segmented(spark, folder))


@query
def sales_findings(spark, folder):
    return rfm.sales_findings(segmented(spark, folder))


# -- text mining ---------------------------------------------------------------------


@query
def word_freq(spark, folder):
    return mining.word_freq(tokens(spark, folder))


@query
def corpus_overview(spark, folder):
    return mining.corpus_overview(documents(spark, folder), tokens(spark, folder), "text")


@query
def tfidf_keywords(spark, folder):
    return mining.tfidf_keywords(tokens_twice(spark, folder))


@query
def bigrams(spark, folder):
    return mining.ngrams(tokens(spark, folder), 2)


@query
def trigrams(spark, folder):
    return mining.ngrams(tokens(spark, folder), 3)


@query
def frequent_words(spark, folder):
    return mining.word_freq(tokens_twice(spark, folder), 1000, two_phase=True)


@query
def frequent_trigrams(spark, folder):
    return mining.ngrams(tokens_twice(spark, folder), 3, two_phase=True)


@query
def lda_topics(spark, folder):
    return topics.lda_topics(topics.fit_topics(tokens_twice(spark, folder), "doc_id"))


@query
def topic_share(spark, folder):
    fitted = topics.fit_topics(tokens_twice(spark, folder), "doc_id")
    return topics.topic_share(fitted, "doc_id")


@query
def cooccurrence(spark, folder):
    return mining.cooccurrence(tokens_twice(spark, folder))


def keyword_edges(spark, folder):
    return reuse(mining.cooccurrence(tokens_twice(spark, folder)))


@query
def degree_centrality(spark, folder):
    return graph.degree_centrality(keyword_edges(spark, folder)).withColumn("degree", F.round("degree", 4))


@query
def betweenness(spark, folder):
    return graph.betweenness(keyword_edges(spark, folder)).withColumn("betweenness", F.round("betweenness", 4))


@query
def communities(spark, folder):
    return graph.communities(keyword_edges(spark, folder))


@query
def components(spark, folder):
    return graph.components(keyword_edges(spark, folder))


@query
def keyword_network(spark, folder):
    return graph.keyword_network(tokens_twice(spark, folder))


@query
def token_sentiment_distribution(spark, folder):
    return mining.token_sentiment_distribution(tk.token_sentiment(tokens(spark, folder), TOKEN_LEXICON))


@query
def token_sentiment_examples(spark, folder):
    return mining.token_sentiment_examples(tk.token_sentiment(tokens(spark, folder), TOKEN_LEXICON), "text", "doc_id")


@query
def cloud_weights(spark, folder):
    return mining.cloud_weights(mining.word_freq(tokens(spark, folder)), TOKEN_LEXICON)


# -- context -------------------------------------------------------------------------


@query
def last_turns(spark, folder):
    return context.last_turns(load_table(spark, folder, "conversations"), TURNS)


@query
def conversation_context(spark, folder):
    return context.conversation_context(load_table(spark, folder, "conversations"), TURNS)


@query
def page_context(spark, folder):
    """Three parts a page: its text, its address under a label, and a note that is blank on every third page."""
    pages = load_table(spark, folder, "pages")
    note = F.when(F.col("page_id") % 3 == 0, "<p> </p>").otherwise("<i>page</i> note")
    cells = F.array(*[F.struct(F.lit(x).alias("part"), c.alias("html")) for x, c in (("summary", F.col("url")), ("note", note), ("analysis", F.col("html")))])
    parts = pages.select("page_id", F.inline(cells))
    return context.build_context(parts, by="page_id", labels={"summary": "Source: "})


# -- tokens of other kinds -----------------------------------------------------------


def listed(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query
def tokenize_lemmas(spark, folder):
    """English words with the lemmas of a table made from the words themselves: those of six to eight letters lose "ing"."""
    texts = reviews(spark, folder)
    words = texts.select(F.explode(tk.english_words(F.col("text"))).alias("token")).distinct()
    lemmas = words.where("token LIKE '%ing' AND length(token) BETWEEN 6 AND 8").withColumn("lemma", F.expr("left(token, length(token) - 3)"))
    return listed(tk.tokenize(texts, "text", stopwords=EXTRA_STOPWORDS, lemmas=lemmas))


def in_script(df: DataFrame, letters: str) -> DataFrame:
    """Texts whose commonest Latin letters are put into another script."""
    return df.withColumn("text", F.translate(F.lower("text"), LATIN, letters))


@query
def tokenize_zh(spark, folder):
    return listed(tk.tokenize(in_script(reviews(spark, folder), CHINESE), "text", "zh", stopwords=[CHINESE[:2]]))


@query
def tokenize_ja(spark, folder):
    return listed(tk.tokenize(in_script(reviews(spark, folder), JAPANESE), "text", "ja", stopwords=[JAPANESE[:2]]))


def tagged(text: Column) -> Column:
    """Words as (form, tag), tagged by their last letter: a stand-in for a morphological analyzer."""
    return F.transform(F.split(F.lower(text), "[^a-z]+"), lambda w: F.struct(
        w.alias("form"), F.when(w.endswith("n"), NOUN_TAGS[0]).when(w.endswith("t"), NOUN_TAGS[1]).otherwise("JKS").alias("tag")))


@query
def tokenize_analyzed(spark, folder):
    return listed(tk.tokenize(reviews(spark, folder), "text", "ko", stopwords=EXTRA_STOPWORDS, analyzer=tagged))


@query
def filter_tokens(spark, folder):
    words = reviews(spark, folder).select("doc_id", F.posexplode(tagged(F.col("text"))).alias("pos", "word"))
    rows = words.select("doc_id", F.col("pos").cast("long").alias("pos"), "word.form", "word.tag")
    return tk.filter_tokens(rows, NOUN_TAGS[:2], min_len=4, stopwords=["then", "that"])
