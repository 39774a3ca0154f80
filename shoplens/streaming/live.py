"""The row-local operators and the daily counts on streaming DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.operators.reviews import Lexicon, Taxonomy, classify, score_sentiment
from shoplens.operators.sales import clean_sales


def live_reviews(stream: DataFrame, text: str, taxonomy: Taxonomy, lexicon: Lexicon) -> DataFrame:
    """Category, score, keywords and label of every arriving review."""
    return score_sentiment(classify(stream, text, taxonomy), text, lexicon).drop("hits")


def live_daily_counts(stream: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """``(day, n)`` per calendar day, final once ``late`` has passed after midnight."""
    utc, here = F.lit("UTC"), F.current_timezone()
    # Watermarks need an instant: the wall-clock time is read as UTC, whose days windows follow.
    instant = F.convert_timezone(utc, here, F.col(ts).cast("timestamp_ntz")).cast("timestamp")
    timed = stream.select(instant.alias("instant")).where("instant IS NOT NULL").withWatermark("instant", late)
    counts = timed.groupBy(F.window("instant", "1 day").alias("w")).agg(F.count("*").alias("n"))
    start = F.convert_timezone(here, utc, F.col("w.start").cast("timestamp_ntz"))
    return counts.select(F.to_date(start).alias("day"), "n")


def live_daily_orders(stream: DataFrame, roles: Mapping[str, str], late: str = "1 hour") -> DataFrame:
    """``(day, n)`` of the valid sales."""
    return live_daily_counts(clean_sales(stream, roles), "order_date", late)
