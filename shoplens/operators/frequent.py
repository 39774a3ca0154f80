"""The most frequent values of a column, exactly, without a shuffle of all distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
# The largest arguments of approx_top_k.
MOST_CANDIDATES, MOST_TRACKED = 100_000, 1_000_000


def most_frequent(values: DataFrame, k: int, buckets: int = BUCKETS, tracked: int | None = None) -> DataFrame:
    """``(<column>, n)``: the ``k`` most frequent strings of the one column of ``values``, ties by value; nulls do not count.

    A pass sums all values by hash bucket, which bounds the count of every value of a bucket
    from above. The values of the heaviest buckets are counted one by one; of the others only
    those in buckets whose sum reaches the kth count found so far, again the heaviest first.
    With ``tracked``, a sketch of that size names ``4 * k`` candidates before, which are counted
    apart from the buckets. At most ``4 * k + buckets`` rows leave the tasks or reach the driver,
    besides the values of buckets counted one by one, which are shuffled. Any sketch gives the
    same result.
    """
    spark, (name,) = values.sparkSession, values.columns
    schema = f"`{name}` string, n long"
    values = values.select(F.col(f"`{name}`").alias("value")).where("value IS NOT NULL")
    if k <= 0:
        return spark.createDataFrame([], schema)
    best, known, bucket, left = bounded_counts(values, k, buckets, tracked)
    some = 4 * k
    while left:
        taken = set(b for b, _ in left[:some])
        # As one literal: the plan of a condition with a literal for each bucket takes minutes.
        wanted = F.split(F.lit(",".join("1" if b in taken else "0" for b in range(buckets))), ",").cast("array<int>")
        others = values.where((F.get(wanted, bucket) == 1) & ~known).groupBy("value").agg(F.count("*").alias("n"))
        best = _first(best + [tuple(r) for r in others.orderBy(F.desc("n"), "value").limit(k).collect()], k)
        least = best[-1][1] if len(best) == k else 0
        left = [(b, n) for b, n in left[some:] if n >= least]
        some *= 16
    return spark.createDataFrame(best, schema).orderBy(F.desc("n"), f"`{name}`")


def bounded_counts(
    values: DataFrame, k: int, buckets: int = BUCKETS, tracked: int | None = None
) -> tuple[list[tuple[str, int]], Column, Column, list[tuple[int, int]]]:
    """The best ``k`` candidates with their counts, the condition for a candidate, the bucket of
    ``value``, and the buckets whose sum reaches the kth candidate with their sums, heaviest first.
    """
    guess = []
    if tracked:
        wanted = min(4 * k, MOST_CANDIDATES)
        tracked = max(wanted, min(tracked, MOST_TRACKED))
        guess = values.agg(F.expr(f"approx_top_k(value, {wanted}, {tracked})")).first()[0] or []
    candidates = [r["item"] for r in guess if r["item"] is not None]
    known = F.col("value").isin(candidates) if candidates else F.lit(False)
    bucket = F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int")
    sums = (
        values.select(F.when(known, F.col("value")).alias("value"), F.when(~known, bucket).alias("bucket"))
        .groupBy("value", "bucket").agg(F.count("*").alias("n")).collect()
    )
    best = _first([(r["value"], r["n"]) for r in sums if r["value"] is not None], k)
    least = best[-1][1] if len(best) == k else 0
    left = [(r["bucket"], r["n"]) for r in sums if r["bucket"] is not None and r["n"] >= least]
    return best, known, bucket, sorted(left, key=lambda b: (-b[1], b[0]))


def _first(counts: list[tuple[str, int]], k: int) -> list[tuple[str, int]]:
    """The first ``k`` by count; equal counts in the order of their UTF-8 bytes, as Spark sorts."""
    return sorted(counts, key=lambda c: (-c[1], c[0].encode("utf-8", "surrogatepass")))[:k]
