"""Quantiles of a table that arrives in parts, from the sketches of its parts."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoplens.operators import quantiles
from shoplens.operators.quantiles import exact_quantiles, quantile_sketches

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
SCHEMA = "day int, a double, b long"


def days(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(5), rng.choice([5.0, rng.gauss(0, 50), None, float("nan")]), rng.randrange(1000)) for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def expected(df):
    table = df.select("a", "b").toPandas()
    return {c: pytest.approx(table[c].dropna().quantile(PROBS).tolist(), abs=1e-9) for c in table}


def scans(spark, monkeypatch, build):
    """Result of ``build`` and how often a pass over the values was made."""
    seen = []
    for name in ("_bracketed", "_brackets", "_narrow", "_finish", "_count_and_read"):
        own = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda *a, own=own, name=name: (seen.append(name), own(*a))[1])
    return build(), seen


def test_a_new_day_costs_its_own_scan_and_one_pass(spark, monkeypatch):
    df = days(spark, 4000)
    kept = quantile_sketches(df.where("day < 4"), ["a", "b"], ["day"]).persist()
    assert kept.columns == ["day", "column", "n", "sketch"] and kept.count() == 8
    both = kept.unionByName(quantile_sketches(df.where("day = 4"), ["a", "b"], ["day"]))
    plain = exact_quantiles(df, ["a", "b"], PROBS)
    got, seen = scans(spark, monkeypatch, lambda: exact_quantiles(df, ["a", "b"], PROBS, both))
    assert got == plain == expected(df)
    assert seen == ["_count_and_read"]
    kept.unpersist()


@pytest.mark.parametrize("size,slack,values", [(8, 0.02, 30), (8, 0.0, 30), (64, 0.002, 3)])
def test_a_coarse_sketch_costs_passes_only(spark, monkeypatch, size, slack, values):
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", size)
    monkeypatch.setattr(quantiles, "SKETCH_SLACK", slack)
    monkeypatch.setattr(quantiles, "FINAL_VALUES", values)
    df = days(spark, 3000, seed=size)
    assert exact_quantiles(df, ["a", "b"], PROBS, quantile_sketches(df, ["a", "b"], ["day"])) == expected(df)


def test_sketches_of_other_rows_are_an_error(spark):
    df = days(spark, 300)
    with pytest.raises(ValueError, match="the sketches count"):
        exact_quantiles(df, ["a"], PROBS, quantile_sketches(df.where("day < 3"), ["a"], ["day"]))
    with pytest.raises(ValueError, match="no sketches of b"):
        exact_quantiles(df, ["a", "b"], PROBS, quantile_sketches(df, ["a"], ["day"]))
    with pytest.raises(ValueError, match="the table does"):
        exact_quantiles(df, ["a"], PROBS, quantile_sketches(df.where("1 = 0"), ["a"], ["day"]))


def test_columns_without_values_and_odd_names(spark):
    df = spark.createDataFrame([(1, None, 2.0), (1, None, 4.0), (None, None, None)], "`a part` int, n double, `_v0` double")
    sketches = quantile_sketches(df, ["n", "_v0"], ["a part"])
    assert exact_quantiles(df, ["n", "_v0"], [0.5], sketches) == {"n": [None], "_v0": [3.0]}
    empty = df.where(F.lit(False))
    assert exact_quantiles(empty, ["n"], [0.5], quantile_sketches(empty, ["n"], ["a part"])) == {"n": [None]}


def test_even_columns_are_cut_without_sketches(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FINAL_VALUES", 20)
    df = spark.range(20000).select((F.col("id") * 7919 % 20011 / 3).alias("a"), (F.col("id") % 11).alias("b"))
    want = expected(df)
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: pytest.fail("a sketch of evenly spread values"))
    assert exact_quantiles(df, ["a", "b"], PROBS) == want


@pytest.mark.parametrize("odd", [
    [1e308, -1e308], [float("inf"), float("-inf")], [5e-324, 0.0, -0.0], [1e300] * 3, [2.0**i for i in range(900)],
    [1 + i * 2.0**-52 for i in range(300)], [None, float("nan")],
])
def test_uneven_columns_stay_exact(spark, monkeypatch, odd):
    monkeypatch.setattr(quantiles, "FINAL_VALUES", 20)
    rng = random.Random(4)
    for values in (odd * 40, odd + [rng.gauss(0, 1) for _ in range(1000)], odd):
        df = spark.createDataFrame([(v,) for v in values], "a double")
        kept = sorted(v for v in values if v is not None and v == v)
        at = [p for p in (0.0, 0.2, 0.5, 0.75, 1.0)]
        exact = [kept[0], kept[-1]] if kept else [None, None]
        got = exact_quantiles(df, ["a"], at)["a"]
        assert [got[0], got[-1]] == exact
        for p, g in zip(at, got):
            k = p * (len(kept) - 1) if kept else 0
            if kept and k == int(k):
                assert g == kept[int(k)]
