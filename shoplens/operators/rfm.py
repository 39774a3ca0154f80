"""Recency / frequency / monetary scores and customer segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.operators.quantiles import exact_quantiles, global_rank
from shoplens.operators.sales import money
from shoplens.session import reuse

SEGMENTS = ("champion", "loyal", "potential", "new", "at_risk", "lost", "general")
CHAMPION, AT_RISK, LOST = "champion", "at_risk", "lost"
FIFTHS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def rfm_base(sales: DataFrame) -> DataFrame:
    """``(customer, R, F, M)``: days since the last purchase, purchases, revenue.

    The per-customer totals are kept; the global last date and the score
    edges are then read from them, not from the sales.
    """
    totals = reuse(
        sales.groupBy("customer").agg(
            F.max("order_date").alias("last_order"),
            F.count("*").alias("F"),
            money("revenue").alias("M"),
        )
    )
    now = totals.agg((F.max("last_order") + F.expr("INTERVAL 1 DAY")).alias("now")).scalar()
    # Whole 24-hour periods, not calendar days.
    days = F.extract(F.lit("DAY"), now - F.col("last_order")).cast("long")
    return totals.select("customer", days.alias("R"), "F", "M")


def _direct(value: Column, edges: Sequence[float]) -> Column:
    return sum((F.when(value > F.lit(e), 1).otherwise(0) for e in edges[1:5]), F.lit(1))


def _by_rank(n: int) -> Column:
    """Fifth of a row by its ``_rank``: the smallest s >= 1 with (rank - 1) * 5 <= s * (n - 1)."""
    if n == 1:
        return F.lit(3)
    return F.greatest(F.lit(1), F.expr(f"((_rank - 1) * 5 + {n - 2}) div {n - 1}").cast("int"))


def quintile_scores(
    df: DataFrame, metrics: dict[str, bool], order_by: str, suffix: str = "_score"
) -> DataFrame:
    """Add a 1..5 score per metric; ``metrics`` maps a column to "5 is the lowest value".

    Scores cut at the exact 20 % quantiles (right-closed). Where two edges coincide,
    rows are ranked by value and then ``order_by`` (unique), and the ranks are cut the
    same way. Each cut costs column scans; a rank costs one range shuffle of the table.
    """
    edges = exact_quantiles(df, list(metrics), FIFTHS)
    n = None
    for metric, low_is_best in metrics.items():
        cuts = edges[metric]
        if cuts[0] is None:
            return df.withColumns({f"{m}{suffix}": F.lit(None).cast("int") for m in metrics})
        if len(set(cuts)) == len(cuts):
            score = _direct(F.col(metric), cuts)
        else:
            n = df.count() if n is None else n
            df = global_rank(df, [metric, order_by], "_rank")
            score = _by_rank(n)
        if low_is_best and n != 1:
            score = F.lit(6) - score
        df = df.withColumn(f"{metric}{suffix}", score.cast("int")).drop("_rank")
    return df


def quintile_score(df: DataFrame, col: str, order_by: str, reverse: bool = False) -> DataFrame:
    """Add ``<col>_score`` for one metric."""
    return quintile_scores(df, {col: reverse}, order_by)


def rfm_scores(sales: DataFrame) -> DataFrame:
    """``(customer, R, F, M, R_score, F_score, M_score)``; a recent purchase scores 5."""
    return quintile_scores(rfm_base(sales), {"R": True, "F": False, "M": False}, order_by="customer")


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """Segment of one score triple; the last one if a score is missing."""
    # Thresholds of the segments; the first that fits names a customer.
    return (
        F.when(r.isNull() | f.isNull() | m.isNull(), "general")
        .when((r >= 4) & (f >= 4) & (m >= 4), "champion")
        .when((f >= 3) & (m >= 3), "loyal")
        .when((r >= 3) & (f >= 2), "potential")
        .when((r >= 4) & (f == 1), "new")
        .when((r <= 2) & (f >= 2), "at_risk")
        .when((r <= 2) & (f <= 2), "lost")
        .otherwise("general")
    )


def rfm_segments(sales: DataFrame) -> DataFrame:
    segment = rfm_segment(F.col("R_score"), F.col("F_score"), F.col("M_score"))
    return rfm_scores(sales).withColumn("segment", segment)


def _share(n: Column, total: Column) -> Column:
    return F.try_divide(n * 100.0, total)


def _customers(rfm: DataFrame) -> Column:
    return rfm.agg(F.count("*").alias("n")).scalar()


def segment_distribution(rfm: DataFrame) -> DataFrame:
    """``(segment, n_customers, pct)``, largest first."""
    return (
        rfm.groupBy("segment")
        .agg(F.count("*").alias("n_customers"))
        .withColumn("pct", F.round(_share(F.col("n_customers"), _customers(rfm)), 2))
        .orderBy(F.desc("n_customers"), "segment")
    )


def _rule_order(segment: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), segment).cast("long")


def segment_scores(rfm: DataFrame) -> DataFrame:
    """``(rule, segment, r, f, m)``: mean scores per segment in rule order."""
    means = [F.round(F.avg(f"{x}_score"), 2).alias(x.lower()) for x in "RFM"]
    table = rfm.groupBy("segment").agg(*means).withColumn("rule", _rule_order(F.col("segment")))
    return table.select("rule", "segment", "r", "f", "m").orderBy("rule")


def segment_summary(rfm: DataFrame) -> DataFrame:
    """``(segment, n_customers, pct, avg_r, avg_f, avg_m)``, largest first."""
    return (
        rfm.groupBy("segment")
        .agg(
            F.count("*").alias("n_customers"),
            F.round(F.avg("R"), 2).alias("avg_r"),
            F.round(F.avg("F"), 2).alias("avg_f"),
            F.round(F.avg("M"), 2).alias("avg_m"),
        )
        .withColumn("pct", F.round(_share(F.col("n_customers"), _customers(rfm)), 2))
        .select("segment", "n_customers", "pct", "avg_r", "avg_f", "avg_m")
        .orderBy(F.desc("n_customers"), "segment")
    )


LOST_ALERT_PCT, AT_RISK_ALERT_PCT = 20, 15


def sales_findings(rfm: DataFrame) -> DataFrame:
    """``(finding, segment, value)``: the conspicuous shares, the largest segment, revenue per order."""
    total = F.sum("n")
    shares = {s: F.try_divide(F.sum(F.when(F.col("segment") == s, F.col("n"))) * 100.0, total)
              for s in (CHAMPION, LOST, AT_RISK)}
    # One row per segment is left at this point: at most len(SEGMENTS) rows.
    facts = rfm.groupBy("segment").agg(
        F.count("*").alias("n"), F.sum("F").alias("orders"), F.sum("M").alias("revenue")
    ).agg(
        *[pct.alias(s) for s, pct in shares.items()],
        F.max(F.struct("n", (-_rule_order(F.col("segment"))).alias("rule"), "segment")).alias("largest"),
        F.try_divide(F.sum("revenue"), F.sum("orders")).alias("per_order"),
    )

    def found(finding: str, segment: Column, value: Column, when: Column) -> Column:
        row = F.struct(F.lit(finding).alias("finding"), segment.alias("segment"), F.round(value, 2).alias("value"))
        return F.when(when, row)

    rows = F.array_compact(
        F.array(
            found("champion_share", F.lit(CHAMPION), F.col(CHAMPION), F.col(CHAMPION) > 0),
            found("lost_share_high", F.lit(LOST), F.col(LOST), F.col(LOST) > LOST_ALERT_PCT),
            found("at_risk_share_high", F.lit(AT_RISK), F.col(AT_RISK), F.col(AT_RISK) > AT_RISK_ALERT_PCT),
            found("largest_segment", F.col("largest.segment"), F.col("largest.n").cast("double"), F.lit(True)),
            found("revenue_per_order", F.lit(None).cast("string"), F.col("per_order"), F.lit(True)),
        )
    )
    return facts.select(F.inline(rows))
