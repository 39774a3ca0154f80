"""Column typing and role detection."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions.coercion import nan_to_null, to_ts

# Name parts that mark a text column.
TEXT_NAME_PARTS = ("리뷰", "내용", "텍스트", "후기", "comment", "review", "content", "body", "text")

# Name parts per commerce role, tested in this order.
ROLE_NAME_PARTS = {
    "date": ("date", "날짜", "일자", "invoicedate", "orderdate", "order_date"),
    "customer": ("customer", "고객", "회원", "user"),
    "product": ("product", "상품", "제품", "item", "description", "stock"),
    "quantity": ("quantity", "수량", "qty"),
    "price": ("price", "가격", "단가", "unit"),
}
# Invoice numbers, never taken for a role before a date column is seen.
INVOICE_NAMES = ("invoice", "invoiceno", "invoice_no")
REQUIRED_ROLES = ("date", "customer", "quantity", "price")

CATEGORICAL_MAX, HIGH_CARDINALITY_MAX = 20, 100


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def unstack(wide: DataFrame, columns: Sequence[str], fields: Sequence[str], schema: str) -> DataFrame:
    """Turn one row of ``field_i`` aggregates into one row per column."""
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), *[F.col(f"{f}_{i}").alias(f) for f in fields])
          for i, c in enumerate(columns)]
    )
    return wide.select(F.inline(rows.cast(f"array<struct<column:string,{schema}>>")))


# -- text column ---------------------------------------------------------------------


def _name_matches(name: str) -> bool:
    return any(part in name.lower() for part in TEXT_NAME_PARTS)


def _average_lengths(df: DataFrame) -> list[float | None]:
    lengths = [F.avg(F.length(quoted(c).cast("string"))).alias(f"len_{i}") for i, c in enumerate(df.columns)]
    return list(nan_to_null(df).agg(*lengths).first())


def _choose_text_column(columns: Sequence[str], lengths: Sequence[float | None]) -> str:
    filled = [(c, n) for c, n in zip(columns, lengths) if n is not None]
    ordered = sorted(filled, key=lambda cn: -cn[1])
    named = [c for c, _ in ordered if _name_matches(c)]
    if named:
        return named[0]
    return ordered[0][0] if ordered else columns[0]


def detect_text_column(df: DataFrame) -> str:
    """The longest column with a text-like name, else the longest column."""
    return _choose_text_column(df.columns, _average_lengths(df))


def text_column_stats(df: DataFrame) -> DataFrame:
    """``(column, avg_len, name_match, chosen)`` for every column."""
    lengths = _average_lengths(df)
    chosen = _choose_text_column(df.columns, lengths)
    rows = [(c, n, _name_matches(c), c == chosen) for c, n in zip(df.columns, lengths)]
    return df.sparkSession.createDataFrame(
        rows, "column string, avg_len double, name_match boolean, chosen boolean"
    )


# -- semantic types ------------------------------------------------------------------


def distinct_key(df: DataFrame, name: str) -> Column:
    """A short string that differs exactly where the values differ; NULL stays NULL.

    Texts above 63 characters are represented by their SHA-256 (64 hex digits), so
    long documents are not shuffled to be counted.
    """
    dtype = df.schema[name].dataType
    c = quoted(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), (c + F.lit(0.0)).cast("string"))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        c = F.to_json(c)
    s = c.cast("string")
    return F.when(F.length(s) > 63, F.sha2(s, 256)).otherwise(s)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)``: all columns in one shuffle, combined before it."""
    keys = df.select(*[distinct_key(df, c).alias(c) for c in columns])
    cells = keys.unpivot([], list(columns), "column", "value").where("value IS NOT NULL")
    return cells.groupBy("column", "value").agg(F.count("*").alias("n"))


def _column_counts(df: DataFrame) -> DataFrame:
    """One pass: ``(column, dtype, n_rows, n_valid, n_dates)``."""
    clean, aggs = nan_to_null(df), []
    for i, field in enumerate(df.schema):
        valid = F.count(quoted(field.name))
        dates = F.lit(0)
        if isinstance(field.dataType, T.StringType):
            dates = F.count(to_ts(df, field.name))
        aggs += [
            F.lit(field.dataType.simpleString()).alias(f"dtype_{i}"),
            F.count("*").alias(f"n_rows_{i}"),
            valid.alias(f"n_valid_{i}"),
            dates.alias(f"n_dates_{i}"),
        ]
    wide = clean.agg(*aggs)
    return unstack(
        wide, df.columns, ("dtype", "n_rows", "n_valid", "n_dates"),
        "dtype:string,n_rows:bigint,n_valid:bigint,n_dates:bigint",
    )


def _distinct_counts(df: DataFrame) -> DataFrame:
    """``_column_counts`` with the exact ``n_unique`` of every column."""
    distinct = value_counts(df, df.columns).groupBy("column").agg(F.count("*").alias("n_unique"))
    # One row per column on both sides.
    return _column_counts(df).join(F.broadcast(distinct), "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0).cast("long")))


def _open_counts(df: DataFrame, limit: int = HIGH_CARDINALITY_MAX + 1) -> DataFrame:
    """``_column_counts`` with ``n_unique`` up to ``limit`` of the columns whose type leaves the role open, 0 for others.

    One scan: each task keeps a set of at most ``limit`` values a column, and sends these
    and its counts; what is shuffled grows with columns and tasks, not with rows.
    """
    clean, cells, sets = nan_to_null(df), [], []
    for i, field in enumerate(df.schema):
        is_open = not is_numeric(field.dataType) and not is_datetime(field.dataType)
        sets.append(is_open)
        cells.append((distinct_key(df, field.name) if is_open else F.when(quoted(field.name).isNotNull(), F.lit(""))).alias(f"k{i}"))
        dates = to_ts(df, field.name).isNotNull() if isinstance(field.dataType, T.StringType) else F.lit(False)
        cells.append(dates.alias(f"d{i}"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, valid, dates, found = 0, [0] * len(sets), [0] * len(sets), [set() for _ in sets]
        for batch in batches:
            rows += batch.num_rows
            for i, is_open in enumerate(sets):
                keys = batch.column(2 * i)
                valid[i] += len(keys) - keys.null_count
                dates[i] += pc.sum(batch.column(2 * i + 1)).as_py() or 0
                if is_open and len(found[i]) < limit:
                    found[i].update(pc.unique(keys.drop_null()).slice(0, 2 * limit).to_pylist())
        out = [(i, None, rows, valid[i], dates[i]) for i in range(len(sets))]
        out += [(i, value, 0, 0, 0) for i, own in enumerate(found) for value in sorted(own)[:limit]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), kind) for c, kind in zip(zip(*out), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
            ["place", "value", "n_rows", "n_valid", "n_dates"])

    sent = clean.select(*cells).mapInArrow(count, "place int, value string, n_rows long, n_valid long, n_dates long")
    counts = ("n_rows", "n_valid", "n_dates")
    values = sent.groupBy("place", "value").agg(*[F.sum(c).alias(c) for c in counts])
    totals = values.groupBy("place").agg(
        *[F.sum(c).alias(c) for c in counts], F.least(F.count("value"), F.lit(limit)).alias("n_unique"))
    names = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "place int, column string, dtype string")
    numbers = (*counts, "n_unique")
    return names.join(F.broadcast(totals), "place", "left").select(
        "column", "dtype", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers])


def _typed(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Counts and distinct values plus the role."""
    numeric = [f.name for f in df.schema if is_numeric(f.dataType)]
    datetime = [f.name for f in df.schema if is_datetime(f.dataType)]
    role = (
        F.when(F.col("column").isin(numeric), "numeric")
        .when(F.col("column").isin(datetime), "datetime")
        .when((F.col("n_valid") > 0) & (F.col("n_dates") == F.col("n_valid")), "datetime")
        .when(F.col("n_unique") <= CATEGORICAL_MAX, "categorical")
        .when(F.col("n_unique") <= HIGH_CARDINALITY_MAX, "high_cardinality")
        .otherwise("text")
    )
    return stats.withColumn("role", role)


def open_types(df: DataFrame) -> DataFrame:
    """Counts and roles; distinct values are counted only where the type does not decide, up to 101."""
    return _typed(df, _open_counts(df))


def column_types(df: DataFrame) -> DataFrame:
    """``(column, dtype, role)``."""
    return open_types(df).select("column", "dtype", "role")


PROFILE_SCHEMA = "column string, dtype string, role string, n_null bigint, null_pct double, n_unique bigint"


def profile(df: DataFrame) -> DataFrame:
    """``(column, dtype, role, n_null, null_pct, n_unique)``."""
    missing = F.col("n_rows") - F.col("n_valid")
    return _typed(df, _distinct_counts(df)).select(
        "column",
        "dtype",
        "role",
        missing.alias("n_null"),
        F.round(F.try_divide(missing * 100.0, F.col("n_rows")), 2).alias("null_pct"),
        "n_unique",
    )


def roles_by_column(df: DataFrame) -> dict[str, str]:
    """The types as driver metadata: one entry per column."""
    return {r["column"]: r["role"] for r in column_types(df).collect()}


# -- commerce roles ------------------------------------------------------------------


def detect_commerce_columns(columns: Sequence[str]) -> dict[str, str]:
    """Role -> first column whose name fits; a column takes only its first fitting rule."""
    found: dict[str, str] = {}
    for name in columns:
        low = name.lower()
        fits = [role for role, parts in ROLE_NAME_PARTS.items() if any(p in low for p in parts)]
        if not fits:
            continue
        if fits[0] != "date" and low in INVOICE_NAMES and "date" not in found:
            continue
        found.setdefault(fits[0], name)
    return found


def resolve_roles(columns: Sequence[str], col_map: Mapping[str, str] | None = None) -> dict[str, str]:
    """Given columns win, detected ones fill the gaps; a missing required role is an error."""
    roles = detect_commerce_columns(columns)
    roles.update({role: name for role, name in (col_map or {}).items() if name})
    missing = [role for role in REQUIRED_ROLES if role not in roles]
    if missing:
        raise ValueError(f"required columns not found: {', '.join(missing)}")
    return roles


def commerce_roles(df: DataFrame, col_map: Mapping[str, str] | None = None) -> DataFrame:
    """``(role, column, n_values)``: the resolved roles and how many rows have a value."""
    roles = resolve_roles(df.columns, col_map)
    wide = nan_to_null(df).agg(*[F.count(quoted(c)).alias(f"n_values_{i}") for i, c in enumerate(roles.values())])
    by_column = unstack(wide, list(roles), ("n_values",), "n_values:bigint")
    names = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    return by_column.select(F.col("column").alias("role"), names[F.col("column")].alias("column"), "n_values")
