import pytest
from pyspark.sql import functions as F

from shoplens.functions.coercion import calendar
from shoplens.functions.text import language_of, strip_html, truncate
from shoplens.operators.rfm import rfm_segment
from shoplens.operators.tokens import token_sentiment, tokenize
from shoplens.streaming.live import live_daily_counts, live_daily_orders, live_reviews


@pytest.fixture
def drain(spark, tmp_path):
    """Run a streaming frame to the end of its files and return the rows."""
    def run(df, name, mode="append"):
        q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start())
        q.awaitTermination(120)
        return spark.table(name).collect()

    return run


def stream_of(spark, path, df):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_reviews_on_a_stream(spark, tmp_path, drain):
    df = spark.createDataFrame([(1, "good <b>sun</b>"), (2, "bad"), (3, None)], "id long, text string")
    stream = stream_of(spark, tmp_path / "in", df)
    taxonomy, lexicon = [("praise", ["good"])], [("good", 1), ("bad", -1)]
    live = live_reviews(stream, "text", taxonomy, lexicon)
    tokens = token_sentiment(tokenize(stream, "text"), lexicon)
    got = {r.id: (r.category, r.score, r.keywords, r.label) for r in drain(live, "reviews")}
    assert got == {1: ("praise", 1, "good", "positive"), 2: ("unclassified", -1, "bad", "negative"),
                   3: ("unclassified", 0, "", "neutral")}
    assert {r.id: (r.tokens, r.label) for r in drain(tokens, "tokens")}[1] == (["good", "sun"], "positive")
    texts = stream.select("id", strip_html("text").alias("plain"), truncate("text", 4).alias("cut"), language_of("text").alias("lang"))
    assert ("good sun", "good", "en") in {tuple(r)[1:] for r in drain(texts, "texts")}


def test_sales_on_a_stream(spark, tmp_path, drain):
    days = [("2024-01-01 10:00", "a", "1", "2"), ("2024-01-01 12:00", "b", "1", "2"), ("2024-01-02", "a", "-1", "2"),
            ("2024-01-02 09:00", "a", "1", "2"), ("2024-01-05", "a", "1", "2"), (None, "a", "1", "1")]
    stream = stream_of(spark, tmp_path / "in", spark.createDataFrame(days, "date string, customer string, quantity string, price string"))
    roles = {c: c for c in ("date", "customer", "quantity", "price")}
    got = {str(r.day): r.n for r in drain(live_daily_orders(stream, roles), "orders", "complete")}
    assert got == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-05": 1}


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul"])
def test_daily_counts_on_a_stream(spark, tmp_path, drain, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    df = spark.createDataFrame([("2024-01-01 10:00",), ("2024-01-01 11:00",), ("2024-01-03 00:00",)], "s string")
    df = df.select(F.col("s").cast("timestamp_ntz").alias("ts"))
    stream = stream_of(spark, tmp_path / "in", df)
    assert {str(r.day): r.n for r in drain(live_daily_counts(stream, "ts"), f"days{zone[:3]}", "complete")} == {"2024-01-01": 2, "2024-01-03": 1}
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    parts = calendar(stream, "ts").withColumn("segment", rfm_segment(F.lit(5), F.lit(5), F.lit(5)))
    assert {(r.month, r.weekday, r.segment) for r in drain(parts, f"parts{zone[:3]}")} == {("2024-01", 0, "champion"), ("2024-01", 2, "champion")}
