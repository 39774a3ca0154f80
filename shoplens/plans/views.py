"""Tables of a folder and the views the analyses start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.operators.columns import resolve_roles
from shoplens.operators.sales import clean_sales


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for CPU-heavy row work on a table of few files.

    A file of one row group is one task. A table with at least one file per core is
    left as it is scanned, without a shuffle; others are hashed on ``key`` (unique ids).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(2 * cores, key)


def raw_sales(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` with its order and part under the names of a sales export."""
    lines = load_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = load_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = load_table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("o_orderdate").alias("order_date"),
            F.col("o_custkey").alias("customer"),
            F.col("p_name").alias("product"),
            F.col("l_quantity").alias("quantity"),
            F.col("p_retailprice").alias("price"),
        )
    )


def sales_view(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_sales(spark, folder)
    return clean_sales(raw, resolve_roles(raw.columns))


def purchases_view(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase events as sales without a product; their dates have times of day."""
    events = load_table(spark, folder, "events").where("event_type = 'purchase'")
    raw = events.select(
        F.col("ts").alias("order_date"),
        F.col("user_id").alias("customer"),
        F.lit(1).alias("quantity"),
        F.col("value").alias("price"),
    )
    return clean_sales(raw, resolve_roles(raw.columns))
