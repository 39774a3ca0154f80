from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.operators.frequent import bounded_counts, most_frequent


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "`a word` string").repartition(5)


def brute(values, k):
    counts = Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda c: (-c[1], c[0].encode()))[:k]


@pytest.mark.parametrize("buckets, tracked", [(1 << 16, None), (4, None), (50, 8)])
def test_equals_brute_force_whatever_the_sketch_says(spark, rows, buckets, tracked):
    rng = np.random.default_rng(4)
    values = [f"w{x}" for x in rng.zipf(1.3, 4000) % 900] + [None] * 50 + ["", "é", "z", "\U0001f600"] * 7
    for k in (1, 2, 40, 5000):
        assert rows(most_frequent(frame(spark, values), k, buckets, tracked), ordered=True) == brute(values, k)


def test_ties_beyond_the_candidates_are_decided_by_value(spark, rows):
    # All equally frequent: the sketch cannot know which come first.
    values = [f"{i:04}" for i in range(1200)] * 2
    assert rows(most_frequent(frame(spark, values), 5, tracked=20), ordered=True) == brute(values, 5)


def test_hot_value_empty_input_and_no_k(spark, rows):
    assert rows(most_frequent(frame(spark, ["x"] * 500 + ["y", "z"]), 2), ordered=True) == [("x", 500), ("y", 1)]
    assert rows(most_frequent(frame(spark, []), 3)) == [] == rows(most_frequent(frame(spark, [None]), 3))
    assert most_frequent(frame(spark, ["x"]), 0).columns == ["a word", "n"]


def test_rare_values_are_not_counted_one_by_one(spark):
    values = frame(spark, ["often"] * 300 + ["also"] * 200 + [f"once {i}" for i in range(2000)]).toDF("value")
    best, _, _, left = bounded_counts(values, 2, tracked=64)
    assert (best, left) == ([("often", 300), ("also", 200)], [])
    # Buckets that hold more than the kth candidate are looked into.
    assert bounded_counts(values, 2, buckets=4, tracked=64)[3] != []


def test_many_open_buckets_do_not_become_as_many_conditions(spark, rows, monkeypatch):
    # Most buckets reach the 50th count, which is 1.
    values = [f"once {i}" for i in range(20000)] + [f"hot {i:02}" for i in range(49)] * 9
    own, longest = type(F.col("x")).isin, [0]
    monkeypatch.setattr(type(F.col("x")), "isin", lambda c, *v: (longest.append(len(v[0])), own(c, *v))[1])
    assert rows(most_frequent(frame(spark, values), 50), ordered=True) == brute(values, 50)
    assert max(longest) <= 200
