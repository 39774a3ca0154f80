"""Sales cleaning, key figures, time series and product rankings."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions.coercion import calendar, to_num, to_ts
from shoplens.operators.columns import quoted

TOP_PRODUCTS = 15


def _amount(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.NumericType):
        return quoted(name).cast("double")
    return to_num(df, name)


def clean_sales(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Valid sales only, with canonical names.

    ``roles`` comes from ``resolve_roles``. Result: ``order_date, customer, product
    (if known), quantity, price, revenue`` and the other columns of ``df`` unchanged; one
    that has a canonical name but another role, or none, is called ``<name>_input``.
    ``cleaning_losses`` counts the rows that are left out.
    """
    sales, valid = _converted(df, roles)
    return sales.where(reduce(Column.__and__, valid.values())).withColumn("revenue", F.col("quantity") * F.col("price"))


def cleaning_losses(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """One row ``(n_rows, n_kept, bad_date, bad_customer, bad_quantity, bad_price)``; a row may have several faults."""
    sales, valid = _converted(df, roles)
    kept = F.coalesce(reduce(Column.__and__, valid.values()), F.lit(False))
    return sales.agg(
        F.count("*").alias("n_rows"), F.count_if(kept).alias("n_kept"),
        *[F.count_if(~F.coalesce(v, F.lit(False))).alias(f"bad_{name}") for name, v in valid.items()])


def _converted(df: DataFrame, roles: Mapping[str, str]) -> tuple[DataFrame, dict[str, Column]]:
    """Rows under canonical names, and what makes each of these columns valid."""
    amounts = {name: _amount(df, roles[name]) for name in ("quantity", "price")}
    converted = {"order_date": to_ts(df, roles["date"]), "customer": quoted(roles["customer"]), **amounts}
    if "product" in roles:
        converted["product"] = quoted(roles["product"])
    used, new = set(roles.values()), {*converted, "revenue"}
    others = [quoted(c).alias(f"{c}_input" if c in new else c) for c in df.columns if c not in used]
    sales = df.select(*others, *[c.alias(name) for name, c in converted.items()])
    valid = {"date": F.col("order_date").isNotNull(), "customer": F.col("customer").isNotNull()}
    for name in amounts:
        # NaN is above zero for Spark; two plain conditions let "> 0" reach the files.
        valid[name] = (F.col(name) > 0) & ~F.isnan(name)
    return sales, valid


def require_rows(sales: DataFrame) -> DataFrame:
    """The sales, or an error when no valid row is left (reads at most one row)."""
    if sales.isEmpty():
        raise ValueError("no valid sales: dates must be readable, quantity and price above zero")
    return sales


def money(amount: str) -> Column:
    """Sum of amounts in decimal arithmetic, the same in any order, as double."""
    return F.sum(F.col(amount).cast("decimal(38,6)")).cast("double")


def sales_kpis(sales: DataFrame) -> DataFrame:
    """One row: period, rows, customers, products, revenue, revenue per row.

    Sales are summed per customer, and products are told apart on their own, so that no
    row is multiplied for the two distinct counts.
    """
    products = F.lit(None).cast("long")
    if "product" in sales.columns:
        products = sales.where("product IS NOT NULL").select("product").distinct().agg(F.count("*")).scalar()
    per = sales.groupBy("customer").agg(
        F.min("order_date").alias("first"), F.max("order_date").alias("last"), F.count("*").alias("n"),
        F.sum(F.col("revenue").cast("decimal(38,6)")).alias("revenue"))
    revenue = F.sum("revenue").cast("double")
    return per.agg(
        F.to_date(F.min("first")).alias("date_min"),
        F.to_date(F.max("last")).alias("date_max"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"),
        F.count("customer").alias("n_customers"),
        products.alias("n_products"),
        F.round(revenue, 2).alias("revenue"),
        F.round(F.try_divide(revenue, F.sum("n")), 2).alias("revenue_per_order"),
    )


def monthly_revenue(sales: DataFrame) -> DataFrame:
    return (
        calendar(sales, "order_date")
        .groupBy("month")
        .agg(F.round(money("revenue"), 2).alias("revenue"))
        .orderBy("month")
    )


def daily_orders(sales: DataFrame) -> DataFrame:
    return calendar(sales, "order_date").groupBy("day").agg(F.count("*").alias("n_orders")).orderBy("day")


def weekday_orders(sales: DataFrame) -> DataFrame:
    """``(weekday, n_orders)``, Monday (0) to Sunday (6), zeros included."""
    wide = sales.agg(
        *[F.count_if(F.weekday("order_date") == d).alias(f"d{d}") for d in range(7)]
    )
    days = F.array(*[F.struct(F.lit(d).alias("weekday"), F.col(f"d{d}").alias("n_orders")) for d in range(7)])
    return wide.select(F.inline(days))


def top_products(sales: DataFrame, by: str = "revenue", k: int = TOP_PRODUCTS) -> DataFrame:
    """``(product, <by>)`` with the k largest totals of ``revenue`` or ``quantity``."""
    return (
        sales.where("product IS NOT NULL")
        .groupBy("product")
        .agg(F.round(money(by), 2).alias(by))
        .orderBy(F.desc(by), "product")
        .limit(k)
    )
