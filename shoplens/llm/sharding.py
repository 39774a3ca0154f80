"""Sharding by longest-processing-time scheduling: near-equal bytes per shard, equal texts together."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoplens.llm.store import written

ROW_OVERHEAD = 8
LARGE_PER_SHARD = 1000  # a group above 1/1000 of a mean shard is scheduled on its own
BUNDLES_PER_SHARD = 100
# Shares of the small groups (in thousandths) in coarse to fine bundles; the fine ones even out the end.
TIERS = (900, 990, 999, 1000)
SLOT_BUCKETS = 1024


def schedule(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each ``(unit, size)``: largest first, each to the least-loaded shard.

    Ties go to the smaller unit and the smaller shard.
    """
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _bundle(group: Column, bundles: int) -> Column:
    """Bundle of a small group, from its hash alone; negative, so that it is no rank of a large group."""
    spread = F.pmod(F.xxhash64(group), F.lit(1000))
    tier = sum((spread >= limit).cast("long") for limit in TIERS[:-1])
    return -1 - (tier * bundles + F.pmod(F.shiftrightunsigned(group, 16), F.lit(bundles)))


def assign_shards(docs: DataFrame, shards: int = 24, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row; rows of equal text share a shard.

    A row's size is its UTF-8 bytes plus 8. Groups larger than 1/1000 of a mean shard,
    of which there are at most ``1000 * shards``, are units of their own. All others are
    bundled by their hash into ``400 * shards`` units of falling size. So the driver
    schedules a bounded number of units, whatever the number of groups, and the small
    units that come last even out the loads.

    Returns ``id``, size, text_crc32, law (``bytes``), shard, slot (gapless from 0 within
    the shard) and grown_shard (null: with one more shard, rows move between all shards).
    A null text is an empty text. Rows with a null or repeated id are rows like any other.
    An empty table gives an empty result; other columns are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = written(docs.select(
        F.col(id),
        (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(body).alias("_group"),
    ), "sharding-rows")
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = [(g, b) for g, b in groups.filter(F.col("_bytes") * shards * LARGE_PER_SHARD > total).collect()]
    large.sort(key=lambda x: (-x[1], x[0]))
    spark, bundle = docs.sparkSession, _bundle(F.col("_group"), shards * BUNDLES_PER_SHARD)
    ranks = spark.createDataFrame([(g, rank) for rank, (g, _) in enumerate(large)], "_group long, _rank long")

    def with_units(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(ranks), "_group", "left").withColumn("_unit", F.coalesce("_rank", bundle))

    sizes = [tuple(r) for r in with_units(groups).groupBy("_unit").agg(F.sum("_bytes")).collect()]
    plan = spark.createDataFrame(list(schedule(sizes, shards).items()), "_unit long, shard int")
    placed = (
        with_units(rows).join(F.broadcast(plan), "_unit")
        .withColumn("_bucket", F.pmod(F.xxhash64(F.col(id), F.col("_group")), F.lit(SLOT_BUCKETS)))
    )
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy("shard", "_bucket").orderBy(F.col(id), "_group")
    return placed.join(F.broadcast(starts), ["shard", "_bucket"]).select(
        id, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_start") + F.row_number().over(within) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
