import pytest
from pyspark.sql import functions as F

from shoplens.functions.text import language_of, truncate
from shoplens.operators import reviews as rv
from shoplens.operators.context import build_context, conversation_context, last_turns
from shoplens.plans.reports import analyze_categories, analyze_sentiment

TAXONOMY = [("delivery", ["배송", "도착"]), ("price", ["1+1", "할인"]), ("praise", ["좋아요", "good"])]
LEXICON = [("great", 1), ("greatest", 2), ("bad", -1)]


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def by_id(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


def test_categories(spark):
    df = texts(spark, "배송 빨라요 좋아요", "1+1 행사", "GOOD", "good", " \t ", None)
    assert by_id(rv.classify(df, "text", TAXONOMY), "category") == [
        "delivery", "price", "unclassified", "praise", "unclassified", "unclassified"]


def test_long_keyword_list(spark):
    taxonomy = [("numbers", [f"#{i}#" for i in range(3000)]), ("praise", ["good"])]
    df = texts(spark, "x #2999# good", "good", "#3000#")
    assert by_id(rv.classify(df, "text", taxonomy), "category") == ["numbers", "praise", "unclassified"]


def test_category_tables(spark, rows):
    df = rv.classify(texts(spark, *(["good"] * 7 + ["할인"] * 2 + ["?"] * 9 + ["g" * 199 + "good"])), "text", TAXONOMY)
    assert rows(rv.category_distribution(df), ordered=True) == [
        (1, "praise", 8, 42.11), (2, "price", 2, 10.53), (3, "unclassified", 9, 47.37)]
    examples = rv.category_examples(df, "text", "id")
    assert {(r.category, r.id) for r in examples.collect()} >= {("praise", 0), ("praise", 4), ("price", 7)}
    assert examples.groupBy("category").count().agg(F.max("count")).first()[0] == 5
    long = rv.category_examples(df.where("id = 18"), "text", "id").first().example
    assert long == "g" * 200 + "..." and len(long) == 203


def test_sentiment(spark):
    scored = rv.score_sentiment(texts(spark, "the greatest", "bad but great", "bad bad", None, "  "), "text", LEXICON)
    assert by_id(scored, "score") == [3, 0, -1, 0, 0]
    assert by_id(scored, "keywords") == ["greatest, great", "great, bad", "bad", "", ""]
    assert by_id(scored, "label") == ["positive", "neutral", "negative", "neutral", "neutral"]


def test_sentiment_tables(spark, rows):
    df = rv.score_sentiment(texts(spark, "great", "great great", "bad", "greatest", "x"), "text", LEXICON)
    assert rows(rv.sentiment_distribution(df), ordered=True) == [
        ("positive", 3, 60.0, 5, 0.8), ("neutral", 1, 20.0, 5, 0.8), ("negative", 1, 20.0, 5, 0.8)]
    assert rows(rv.top_keywords(df, 1)) == [("negative", 1, "bad", 1), ("positive", 1, "great", 3)]
    assert rows(rv.keyword_weights(df)) == [
        ("bad", -1, 1, "negative"), ("great", 1, 3, "positive"), ("greatest", 2, 1, "strong_positive")]
    assert rows(rv.strongest_keywords(df, 1)) == [("negative", 1, "bad", 1), ("positive", 1, "greatest", 2)]
    shown = rows(rv.representative_reviews(df, "text", "id", k=2))
    assert shown == [
        ("negative", 1, 2, "bad", -1, "bad"), ("neutral", 1, 4, "x", 0, ""),
        ("positive", 1, 3, "greatest", 3, "greatest, great"), ("positive", 2, 0, "great", 1, "great")]


def test_language(spark):
    df = texts(spark, "배송이 빨라요", "很好吃", "とても良い", "良い", "hello", "", None, "123")
    assert by_id(df.withColumn("l", language_of("text")), "l") == ["ko", "zh", "ja", "zh", "en", "en", "en", "en"]


def test_truncate_counts_characters(spark):
    df = texts(spark, "배송이빨라요", "ab")
    assert by_id(df.withColumn("t", truncate("text", 3, "...")), "t") == ["배송이...", "ab"]


def test_reports(spark):
    df = texts(spark, "great 배송", "bad", None)
    tables = analyze_categories(df, "id", TAXONOMY)
    assert tables["rows"].columns == ["id", "text", "category"] and tables["examples"].count() == 3
    tables = analyze_sentiment(df, "id", LEXICON)
    assert tables["rows"].columns == ["id", "text", "label", "score", "keywords"]
    assert tables["representatives"].count() == 3 and tables["keyword_weights"].count() == 2


def test_last_turns(spark, rows):
    df = spark.createDataFrame([("a", t, "user", f"t{t}") for t in range(1, 13)] + [("b", 1, "user", "x")],
                               "conv_id string, turn long, role string, text string")
    kept = last_turns(df, 10)
    assert sorted(r.turn for r in kept.where("conv_id = 'a'").collect()) == list(range(3, 13))
    assert rows(conversation_context(df, 2)) == [("a", "user: t11\n\nuser: t12"), ("b", "user: x")]


def test_context(spark, rows):
    parts = spark.createDataFrame(
        [("j", "details", "c"), ("j", "analysis", "<b>a</b>  b"), ("j", "summary", " <p></p> "), ("k", "summary", "s")],
        "job_id string, part string, html string")
    more = parts.sparkSession.createDataFrame(
        [("m", "summary", "b"), ("m", "summary", "a"), ("m", "extra", "zzz"), ("m", None, "last?")], parts.schema)
    assert rows(build_context(more)) == [("m", "a\n\nb\n\nlast?\n\nzzz")]
    assert rows(build_context(parts)) == [("j", "a b\n\nc"), ("k", "s")]
    assert rows(build_context(parts, labels={"details": "Details:\n"})) == [("j", "a b\n\nDetails:\nc"), ("k", "s")]


def test_no_python_and_no_cross_product_in_plans(spark):
    df = rv.score_sentiment(rv.classify(texts(spark, "a"), "text", TAXONOMY), "text", LEXICON)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "CartesianProduct", "NestedLoop"):
        assert word not in plan
