import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoplens.functions.coercion import to_num, to_ts
from shoplens.operators import rfm, sales
from shoplens.operators.columns import detect_commerce_columns, resolve_roles
from shoplens.operators.quantiles import exact_quantiles, global_rank
from shoplens.plans.reports import analyze_sales

SALES = [
    ("2024-01-01 09:00", "A", "apple", "2", "10"), ("2024-01-31 23:00", "A", "pear", "1", "5"),
    ("2024-02-03 00:00", "B", "apple", "1", "10"), ("2024-02-03 12:00", "C", "pear", "4", "5"),
    ("2024-02-04 08:00", "C", "apple", "1", "10"),
    ("not-a-date", "A", "apple", "1", "10"), ("2024-02-01", "A", "apple", "-1", "10"),
    ("2024-02-01", "B", "apple", "1", None), ("2024-02-01", None, "apple", "1", "10"),
    ("2024-02-01", "B", "apple", "two", "10"), ("2024-02-01", "B", "apple", "1", "0"),
]
SCHEMA = "date string, customer string, product string, quantity string, price string"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(SALES, SCHEMA)


@pytest.fixture(scope="module")
def clean(raw):
    return sales.clean_sales(raw, resolve_roles(raw.columns))


def test_cleaning_and_key_figures(clean, rows):
    assert clean.count() == 5
    k = sales.sales_kpis(clean).first()
    assert (str(k.date_min), str(k.date_max)) == ("2024-01-01", "2024-02-04")
    assert (k.n_orders, k.n_customers, k.n_products, k.revenue, k.revenue_per_order) == (5, 3, 2, 65, 13)
    assert sales.sales_kpis(clean.drop("product")).first().n_products is None


def test_time_tables(clean, rows):
    assert rows(sales.monthly_revenue(clean), ordered=True) == [("2024-01", 25.0), ("2024-02", 40.0)]
    assert [r.n_orders for r in sales.daily_orders(clean).collect()] == [1, 1, 2, 1]
    assert rows(sales.weekday_orders(clean), ordered=True) == list(enumerate([1, 0, 1, 0, 0, 2, 1]))


def test_products(clean, rows):
    assert rows(sales.top_products(clean), ordered=True) == [("apple", 40.0), ("pear", 25.0)]
    assert rows(sales.top_products(clean, "quantity"), ordered=True) == [("pear", 5.0), ("apple", 4.0)]


def test_rfm_of_the_fixture(clean, rows):
    got = rows(rfm.rfm_segments(clean), "customer", "R", "F", "M", "R_score", "F_score", "M_score", "segment")
    assert got == [
        ("A", 4, 2, 25.0, 1, 3, 3, "loyal"),
        ("B", 2, 1, 10.0, 3, 1, 1, "general"),
        ("C", 1, 2, 30.0, 5, 5, 5, "champion"),
    ]


def test_segment_tables(clean):
    scored = rfm.rfm_segments(clean)
    shares = rfm.segment_distribution(scored).collect()
    assert sum(r.n_customers for r in shares) == 3 and abs(sum(r.pct for r in shares) - 100) < 0.05
    assert [r.segment for r in rfm.segment_scores(scored).collect()] == ["champion", "loyal", "general"]
    assert {r.segment: r.avg_m for r in rfm.segment_summary(scored).collect()} == {
        "champion": 30.0, "loyal": 25.0, "general": 10.0}
    found = {r.finding: (r.segment, r.value) for r in rfm.sales_findings(scored).collect()}
    assert found == {
        "champion_share": ("champion", 33.33),
        "largest_segment": ("champion", 1.0),
        "revenue_per_order": (None, 13.0),
    }


def test_one_customer_scores_three(clean, rows):
    one = rfm.rfm_scores(clean.where("customer = 'A'"))
    assert rows(one, "R_score", "F_score", "M_score") == [(3, 3, 3)]


def test_all_score_triples(spark):
    triples = spark.createDataFrame(list(itertools.product(range(1, 6), repeat=3)), "r int, f int, m int")
    counts = triples.groupBy(rfm.rfm_segment(F.col("r"), F.col("f"), F.col("m")).alias("s")).count()
    assert {r.s: r["count"] for r in counts.collect()} == {
        "champion": 8, "loyal": 37, "potential": 33, "new": 10, "at_risk": 22, "lost": 10, "general": 5}


@pytest.mark.parametrize("n, scores", [
    (1, [3]), (2, [1, 5]), (3, [1, 3, 5]), (4, [1, 2, 4, 5]), (7, [1, 1, 2, 3, 4, 5, 5]),
    (12, [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5]),
])
def test_ties_are_cut_by_rank(spark, n, scores):
    df = spark.createDataFrame([(i, 7) for i in range(n)], "id long, v long")
    scored = rfm.quintile_score(df, "v", "id")
    assert [r.v_score for r in scored.orderBy("id").collect()] == scores
    if n > 1:
        low_best = rfm.quintile_score(df, "v", "id", reverse=True)
        assert [r.v_score for r in low_best.orderBy("id").collect()] == [6 - s for s in scores]


def pandas_scores(values):
    s = pd.Series(values)
    try:
        return pd.qcut(s, 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    except ValueError:
        return pd.qcut(s.rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()


@pytest.mark.parametrize("n, spread", [(2, 3), (9, 4), (30, 100), (57, 5), (111, 1000), (200, 20)])
def test_quintiles_match_pandas(spark, n, spread):
    rng = random.Random(n)
    values = [rng.randrange(spread) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    got = [r.v_score for r in rfm.quintile_score(df, "v", "id").orderBy("id").collect()]
    assert got == pandas_scores(values)


def test_exact_quantiles_with_a_hot_value(spark, monkeypatch):
    """A third of the rows share one value; intervals are narrowed until they are small."""
    from shoplens.operators import quantiles
    monkeypatch.setattr(quantiles, "FINAL_VALUES", 20)
    rng = random.Random(3)
    values = [5.0] * 1000 + [rng.gauss(0, 50) for _ in range(2000)] + [float(rng.randrange(10)) for _ in range(500)]
    rng.shuffle(values)
    df = spark.createDataFrame([(v, v * 2) for v in values] + [(None, float("nan"))], "a double, b double")
    probs = [0.0, 0.01, 0.2, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs)
    assert got["a"] == pytest.approx(pd.Series(values).quantile(probs).tolist(), abs=1e-12)
    assert got["b"] == pytest.approx([2 * x for x in got["a"]], abs=1e-12)


def test_exact_quantiles_with_a_coarse_sketch(spark, monkeypatch):
    from shoplens.operators import quantiles
    monkeypatch.setattr(quantiles, "FINAL_VALUES", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 10)
    monkeypatch.setattr(quantiles, "SLACK", 0.02)
    values = [(i * 7919) % 10007 for i in range(6000)]
    df = spark.createDataFrame([(v,) for v in values], "a long")
    assert exact_quantiles(df, ["a"], [0.1, 0.5, 0.9])["a"] == pytest.approx(
        pd.Series(values).quantile([0.1, 0.5, 0.9]).tolist())


def test_global_rank_splits_a_hot_value(spark):
    data = [(1 if i % 3 else i, i) for i in range(2000)]
    ranked = global_rank(spark.createDataFrame(data, "v long, id long").repartition(7), ["v", "id"], "rank")
    got = [(r.v, r.id) for r in ranked.orderBy("rank").collect()]
    assert got == sorted(data)
    assert [r.rank for r in ranked.orderBy("rank").select("rank").collect()] == list(range(1, 2001))


def test_role_detection():
    names = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"]
    assert detect_commerce_columns(names) == {
        "product": "StockCode", "quantity": "Quantity", "date": "InvoiceDate", "price": "UnitPrice",
        "customer": "CustomerID"}
    assert detect_commerce_columns(["날짜", "고객", "상품", "수량", "단가"]) == dict(
        zip(("date", "customer", "product", "quantity", "price"), ["날짜", "고객", "상품", "수량", "단가"]))
    roles = resolve_roles(["a", "b", "qty", "price"], {"date": "a", "customer": "b", "product": ""})
    assert roles == {"date": "a", "customer": "b", "quantity": "qty", "price": "price"}
    with pytest.raises(ValueError, match="customer, price"):
        resolve_roles(["date", "qty"])


@pytest.mark.parametrize("text, day", [
    ("2024-01-02", "2024-01-02 00:00:00"), ("2024/1/2", "2024-01-02 00:00:00"), ("2024.01.02 7:05", "2024-01-02 07:05:00"),
    ("12/1/2010 8:26", "2010-12-01 08:26:00"), ("20240102", "2024-01-02 00:00:00"),
    ("2024-01-02T03:04:05", "2024-01-02 03:04:05"), ("2024-02-30", None), ("2024", None), ("12:30", None), ("x", None),
])
def test_dates(spark, text, day):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(to_ts(df, "s").cast("string")).first()[0] == day


@pytest.mark.parametrize("text, number", [
    ("1.5", 1.5), (" 2 ", 2.0), ("-3e2", -300.0), (".5", 0.5), ("two", None), ("", None), ("1d", None), ("1,5", None),
])
def test_numbers(spark, text, number):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(to_num(df, "s")).first()[0] == number


def test_dimensions(raw):
    everything = analyze_sales(raw)
    assert {"kpis", "monthly_revenue", "top_products_revenue", "rfm", "findings"} <= set(everything)
    assert everything["kpis"].first().n_orders == 5
    assert set(analyze_sales(raw, dimensions=["product"])) == {"kpis", "top_products_revenue", "top_products_quantity"}
    assert set(analyze_sales(raw.drop("product"), dimensions=["product"])) == {"kpis"}
    with pytest.raises(ValueError, match="price"):
        analyze_sales(raw.drop("price"))
    with pytest.raises(ValueError, match="no valid sales"):
        analyze_sales(raw.where("price = '0'"))


def test_dates_with_month_names_half_days_and_whole_numbers(spark):
    texts = ["05-Jan-2024", "Jan 5, 2024", "1/5/2024 3:04 PM", "January 5 2024 12:00 am", "5 sept. 2024", "20240105", "5-Foo-2024", "32-Jan-2024"]
    df = spark.createDataFrame([(x,) for x in texts], "d string")
    got = [str(r.t) for r in df.select(to_ts(df, "d").alias("t")).collect()]
    assert got == ["2024-01-05 00:00:00", "2024-01-05 00:00:00", "2024-01-05 15:04:00", "2024-01-05 00:00:00", "2024-09-05 00:00:00",
                   "2024-01-05 00:00:00", "None", "None"]
    numbers = spark.createDataFrame([(20240105,), (20241345,), (7,)], "d long")
    assert [str(r.t) for r in numbers.select(to_ts(numbers, "d").alias("t")).collect()] == ["2024-01-05 00:00:00", "None", "None"]


def test_cleaning_reports_losses_and_keeps_other_columns(spark, rows):
    df = spark.createDataFrame(
        [("2024-01-01", "a", 1.0, 2.0, "x"), ("nope", "a", 1.0, 2.0, "y"), ("2024-01-02", None, -1.0, 2.0, "z")],
        "day string, who string, n double, each double, price string")
    roles = {"date": "day", "customer": "who", "quantity": "n", "price": "each"}
    assert rows(sales.clean_sales(df, roles), "price_input", "price", "revenue") == [("x", 2.0, 2.0)]
    assert rows(sales.cleaning_losses(df, roles)) == [(3, 1, 1, 1, 1, 0)]
