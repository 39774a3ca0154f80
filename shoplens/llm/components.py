"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.store import new_folder, remove


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` of every node of ``edges`` (``a``, ``b`` long): root is the component's smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones, on the
    smallest node it sees, until nothing changes; the number of rounds grows with the
    logarithm of the longest path. Minima are aggregated before the shuffle and joined
    back, so a node with very many edges is no single group. Loops and repeated edges
    are allowed; rows with a null end are left out; without edges the result is empty.
    A round's table replaces the one before it in the shared folder.
    """
    spark = edges.sparkSession
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    folder = seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(lowest, "u").select(
            F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        after = smaller.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        old, folder = folder, new_folder(spark, "components")
        after.write.parquet(folder)
        pairs = spark.read.schema("u long, v long").parquet(folder)
        if old:
            remove(spark, old)
        state = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
