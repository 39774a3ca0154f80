import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.functions.text import strip_html
from shoplens.operators import eda, moments
from shoplens.operators.columns import column_types, detect_text_column, profile, text_column_stats
from shoplens.plans.reports import analyze_table


@pytest.fixture(scope="module")
def x(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 100.0])], "id long, x double").select("x", "id")


def test_describe(x):
    r = eda.describe(x, ["x"]).first()
    assert tuple(r) == ("x", 5, 22.0, 43.62, 1.0, 2.0, 3.0, 4.0, 100.0)


def test_outliers(x, rows):
    assert rows(eda.iqr_outliers(x, ["x"])) == [("x", 2.0, 4.0, -1.0, 7.0, 1, 20.0)]
    assert rows(eda.outlier_examples(x, "id", ["x"])) == [("x", 1, -1.0, 7.0, 1, 100.0)]
    assert rows(eda.outlier_examples(x.where("x < 50"), "id", ["x"])) == [("x", 0, -0.5, 5.5, None, None)]
    assert rows(eda.box_stats(x, ["x"])) == [("x", 2.0, 3.0, 4.0, 1.0, 4.0, 22.0, 43.6177)]


def test_duplicates_and_missing(spark, rows):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "a int, b string")
    r = eda.overview(df).first()
    assert (r.n_rows, r.n_columns, r.n_missing, r.missing_pct, r.n_duplicates) == (3, 2, 1, 16.67, 1)
    assert (r.n_numeric, r.n_categorical, r.n_datetime, r.n_text) == (1, 1, 0, 0)
    assert rows(eda.missing_summary(df)) == [("a", 1, 33.33)]
    assert rows(profile(df)) == [("a", "int", "numeric", 1, 33.33, 1), ("b", "string", "categorical", 0, 0.0, 2)]


def test_nulls_in_different_columns_are_different_rows(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), ("x", None)], "a string, b string")
    assert eda.overview(df).first().n_duplicates == 1


def test_correlation(spark):
    df = spark.createDataFrame([(1, 2, 5), (2, 4, 5), (None, 9, 5), (4, 7, 5)], "x int, y int, z int")
    got = {(r.x, r.y): r.r for r in eda.correlation(df).collect()}
    assert got["x", "y"] == got["y", "x"] == 0.9972
    assert got["x", "x"] == 1.0 and got["z", "z"] is None and got["x", "z"] is None
    assert eda.correlation(df, ["x"]).count() == 0


def test_types(spark):
    n = 101
    data = [("2024-01-02", "2024", "12:30", str(i % 20), str(i % 21), str(i % 100), str(i), None, i % 2 == 0) for i in range(n)]
    columns = ["day", "year", "time", "c20", "c21", "c100", "c101", "none", "flag"]
    df = spark.createDataFrame(data, ", ".join(f"{c} {'boolean' if c == 'flag' else 'string'}" for c in columns))
    assert {r["column"]: r.role for r in column_types(df).collect()} == {
        "day": "datetime", "year": "categorical", "time": "categorical", "c20": "categorical",
        "c21": "high_cardinality", "c100": "high_cardinality", "c101": "text", "none": "categorical",
        "flag": "categorical"}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (3.0,)], "v double")
    assert eda.describe(df).first().n == 2 and eda.describe(df).first().max == 3.0
    assert profile(df).first().n_null == 1


def test_histogram(spark):
    df = spark.createDataFrame([(float(i), 4.0, None) for i in range(31)], "v double, c double, n double")
    bins = eda.histogram(df, ["v", "c", "n"]).orderBy("column", "bin").collect()
    assert [(r.bin, r.lo, r.hi, r.n) for r in bins if r["column"] == "c"] == [(0, 4.0, 4.0, 31)]
    v = [r for r in bins if r["column"] == "v"]
    assert len(v) == 30 and sum(r.n for r in v) == 31 and v[-1].n == 2 and v[-1].hi == 30.0
    assert not [r for r in bins if r["column"] == "n"]


def test_top_values(spark, rows):
    df = spark.createDataFrame([(c, d, str(i)) for i, (c, d) in enumerate(["ax", "ay", "bx", "az"] * 30)], "c string, d string, e string")
    assert rows(eda.top_values(df), ordered=False) == [
        ("c", 1, "a", 90), ("c", 2, "b", 30), ("d", 1, "x", 60), ("d", 2, "y", 30), ("d", 3, "z", 30)]
    assert eda.top_values(df, k=1).count() == 2


def test_daily_counts(spark):
    df = spark.createDataFrame([("2024-01-02 10:00",), ("2024-01-02",), ("2024-01-04",), (None,)], "d string")
    assert [(str(r.day), r.n) for r in eda.daily_counts(df).collect()] == [("2024-01-02", 2), ("2024-01-04", 1)]


def test_top_variance(spark):
    df = spark.createDataFrame([(i, 10 * i, 100 * i, 1) for i in range(5)], "a int, b int, c int, d int")
    assert [r["column"] for r in eda.top_variance(df, 2).collect()] == ["c", "b"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "v double, s string")
    r = eda.overview(df).first()
    assert (r.n_rows, r.missing_pct, r.n_duplicates) == (0, None, 0)
    assert eda.describe(df).first().p50 is None
    assert eda.iqr_outliers(df).count() == 0 and eda.histogram(df).count() == 0
    assert [r.null_pct for r in profile(df).collect()] == [None, None]


def test_text_column(spark):
    df = spark.createDataFrame([("x" * 50, "short", 1)], "notes string, Review_Body string, n int")
    assert detect_text_column(df) == "Review_Body"
    assert detect_text_column(df.drop("Review_Body")) == "notes"
    empty = spark.createDataFrame([(None, None)], "a string, b string")
    assert detect_text_column(empty) == "a"
    assert {r["column"]: r.chosen for r in text_column_stats(df).collect()}["Review_Body"]


def test_strip_html(spark):
    df = spark.createDataFrame([("<b>a</b>　\n b<br\n/>",)], "h string")
    assert df.select(strip_html("h")).first()[0] == "a b"


def test_report(spark):
    df = spark.createDataFrame([(i, i * 2.0, "ab"[i % 2], f"2024-01-{i + 1:02d}") for i in range(20)], "id int, v double, c string, d string")
    tables = analyze_table(df, "id")
    assert {"overview", "profile", "describe", "histogram", "outliers", "correlation", "daily_counts"} <= set(tables)
    assert tables["daily_counts"].count() == 20


def test_correlation_equals_brute_force_with_missing_values(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(400, 6)) * [1, 1e-3, 1e6, 1, 1, 1] + [0, 5, 1e9, 0, 0, 0]
    values[:, 3] = values[:, 0] * 2 + rng.normal(size=400) * 0.1
    values[:, 4] = 0.1  # constant
    values[:, 5] = np.nan
    values[:1, 5] = 3
    values[rng.random(values.shape) < 0.2] = np.nan
    names = list("abcdef")
    rows = [tuple(None if i % 2 and x != x else float(x) for x in row) for i, row in enumerate(values)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7)
    got = {(r.x, r.y): r.r for r in eda.correlation(df).collect()}
    assert len(got) == 36
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            a, b = values[:, i], values[:, j]
            both = ~np.isnan(a) & ~np.isnan(b)
            flat = both.sum() < 2 or np.ptp(a[both]) == 0 or np.ptp(b[both]) == 0
            assert got[x, y] is None if flat else got[x, y] == pytest.approx(np.corrcoef(a[both], b[both])[0, 1], abs=1e-4)


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(6)
    values = rng.normal(size=(90, 4)) + 1e6
    present = rng.random((90, 4)) < 0.7
    whole = moments.batch_moments(values, present)
    parts = [moments.batch_moments(values[a:b], present[a:b]) for a, b in ((0, 1), (1, 30), (30, 30), (30, 90))]
    for order in ((0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)):
        total = np.zeros((4, 4, 4))
        for i in order:
            total = moments.merged_moments(total, parts[i])
        assert np.allclose(total, whole, rtol=1e-9, atol=1e-6)


def test_hundred_columns_add_no_rows(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 7).alias(f"c{i}") for i in range(100)])
    found = eda.correlation(df)
    assert found.count() == 10_000 and "Generate" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("distinct, role", [(20, "categorical"), (21, "high_cardinality"), (100, "high_cardinality"), (101, "text"), (5000, "text")])
def test_roles_at_the_limits_over_many_tasks(spark, distinct, role):
    df = spark.range(0, 20_000, 1, 16).select(F.concat(F.lit("v"), F.col("id") % distinct).alias("v"), F.lit(None).cast("string").alias("none"))
    assert [tuple(r) for r in column_types(df).collect()] == [("v", "string", role), ("none", "string", "categorical")]
    assert [r.role for r in column_types(df.limit(0)).collect()] == ["categorical", "categorical"]


def test_rows_differ_where_their_cells_do(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), ("", "a"), ("1:a", ""), ("1", ":a"), ("a", "a")], "x string, y string")
    assert eda.overview(df).first().n_duplicates == 1
    assert df.select(*eda.row_digest(df)).distinct().count() == 6
