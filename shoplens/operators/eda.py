"""Exploratory statistics of any table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.functions.coercion import nan_to_null, to_ts
from shoplens.operators.columns import (
    column_types,
    distinct_key,
    numeric_columns,
    open_types,
    quoted,
    roles_by_column,
    unstack,
)
from shoplens.operators.moments import correlations
from shoplens.operators.quantiles import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]
Quartiles = Mapping[str, Sequence[float | None]]


def _number(name: str) -> Column:
    return quoted(name).cast("double")


def _unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value)`` for the non-null numbers.

    A few aggregates over long rows stay small generated code however many columns
    there are; the same aggregates side by side soon exceed what the JVM compiles.
    """
    numbers = df.select(*[_number(c).alias(c) for c in columns])
    return numbers.unpivot([], list(columns), "column", "value").where("value IS NOT NULL")


def _per_column(summary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each of ``columns``, also for those without values."""
    names = _rows(summary, [(c,) for c in columns], "column string")
    return names.join(F.broadcast(summary), "column", "left")


def half_even(x: Column, digits: int) -> Column:
    """Round as statistics packages do: the scaled value to the nearest integer, halves to even."""
    return F.rint(x * 10**digits) / 10**digits


def _rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes (``low``, ``high``) of a row's cells, each marked as NULL or preceded by its length."""
    cells = []
    for name in df.columns:
        key = distinct_key(df, name)
        cells.append(F.coalesce(F.concat(F.length(key).cast("string"), F.lit(":"), key), F.lit("-")))
    return [F.xxhash64(F.lit(""), *cells).alias("low"), F.xxhash64(F.lit("high"), *cells).alias("high")]


def overview(df: DataFrame, roles: Mapping[str, str] | None = None) -> DataFrame:
    """One row: size, missing cells, repeated rows, number of columns per role.

    ``roles`` (column -> role), where known already, saves counting distinct values again.
    """
    shown = {"n_numeric": ["numeric"], "n_categorical": ["categorical"], "n_datetime": ["datetime"],
             "n_text": ["text", "high_cardinality"]}
    if roles is None:
        counts = [F.count_if(F.col("role").isin(wanted)).alias(name) for name, wanted in shown.items()]
        role_counts = column_types(df).agg(F.struct(*counts).alias("roles")).scalar()
    else:
        counts = {name: sum(r in wanted for r in roles.values()) for name, wanted in shown.items()}
        role_counts = F.struct(*[F.lit(n).cast("long").alias(name) for name, n in counts.items()])
    clean = nan_to_null(df)
    nulls = sum((F.when(quoted(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    # Rows are compared by a digest of 128 bits, however many columns they have; equal ones are combined before the shuffle.
    keys = clean.select(*row_digest(df), nulls.alias("nulls"))
    per_row = keys.groupBy("low", "high").agg(F.count("*").alias("n"), F.sum("nulls").alias("nulls"))
    totals = per_row.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )
    cells = F.col("n_rows") * len(df.columns)
    return totals.select(
        "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        "n_missing",
        F.round(F.try_divide(F.col("n_missing") * 100.0, cells), 2).alias("missing_pct"),
        "n_duplicates",
        role_counts.alias("roles"),
    ).select("*", "roles.*").drop("roles")


def quartiles(
    df: DataFrame, columns: Sequence[str] | None = None, sketches: DataFrame | None = None
) -> dict[str, list[float | None]]:
    """Exact quartiles per column; the operators below share them through ``known``.

    ``sketches`` of the table's parts (``quantile_sketches``) save a scan.
    """
    return exact_quantiles(nan_to_null(df), list(columns or numeric_columns(df)), QUARTILES, sketches)


def _with_quantiles(table: DataFrame, q: Quartiles, names: Sequence[str], digits: int) -> DataFrame:
    """``table`` with known quantiles of its ``column``, one result column per name; one row per column is joined."""
    schema = "column string, " + ", ".join(f"{name} double" for name in names)
    rows = [(c, *(None if v is None else float(v) for v in values)) for c, values in q.items()]
    rounded = [half_even(F.col(name), digits).alias(name) for name in names]
    return table.join(F.broadcast(_rows(table, rows, schema).select("column", *rounded)), "column", "left")


def describe(df: DataFrame, columns: Sequence[str] | None = None, known: Quartiles | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of each numeric column, rounded to 2."""
    columns = list(columns or numeric_columns(df))
    clean = nan_to_null(df)
    known = known or quartiles(df, columns)
    wide = clean.select(*[_number(c).alias(f"v{i}") for i, c in enumerate(columns)]).agg(*[
        F.struct(
            F.lit(c).alias("column"),
            F.count(v).alias("n"),
            half_even(F.avg(v), 2).alias("mean"),
            half_even(F.stddev_samp(v), 2).alias("std"),
            half_even(F.min(v), 2).alias("min"),
            half_even(F.max(v), 2).alias("max"),
        ).alias(v) for v, c in ((f"v{i}", c) for i, c in enumerate(columns))
    ])
    summary = wide.select(F.inline(F.array(*[f"v{i}" for i in range(len(columns))])))
    names = ("p25", "p50", "p75")
    return _with_quantiles(summary, known, names, 2).select("column", "n", "mean", "std", "min", *names, "max")


def top_variance(df: DataFrame, k: int = 3) -> DataFrame:
    """``(column, variance)``: the k numeric columns with the largest sample variance."""
    columns = numeric_columns(df)
    wide = nan_to_null(df).agg(*[F.var_samp(_number(c)).alias(f"variance_{i}") for i, c in enumerate(columns)])
    rows = unstack(wide, columns, ("variance",), "variance:double")
    rows = rows.select("column", F.round("variance", 2).alias("variance"))
    return rows.orderBy(F.desc_nulls_last("variance"), "column").limit(k)


def _most_variable(df: DataFrame, k: int = 3) -> list[str]:
    columns = numeric_columns(df)
    return columns if len(columns) <= k else [r["column"] for r in top_variance(df, k).collect()]


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """``(column, bin, lo, hi, n)``: equal-width bins on [min, max], empty ones included.

    One aggregation finds the limits, a second one counts; a constant column is one bin.
    """
    columns = list(columns or _most_variable(df))
    clean = nan_to_null(df)
    limits = clean.agg(*[f(_number(c)) for c in columns for f in (F.min, F.max)]).first()
    places, edges = [], []
    for c, lo, hi in zip(columns, limits[::2], limits[1::2]):
        if lo is None:
            continue
        if lo == hi:
            places.append(F.when(_number(c).isNotNull(), F.lit(0).cast("long")).alias(c))
            edges.append((c, 0, lo, hi))
            continue
        place = F.floor((_number(c) - F.lit(lo)) / F.lit(hi - lo) * bins)
        # least() would skip a NULL.
        places.append(F.when(place < bins, place).when(place >= bins, F.lit(bins - 1).cast("long")).alias(c))
        step = (hi - lo) / bins
        edges += [(c, b, lo + b * step, hi if b == bins - 1 else lo + (b + 1) * step) for b in range(bins)]
    frame = _rows(df, edges, "column string, bin bigint, lo double, hi double")
    if not edges:
        return frame.withColumn("n", F.lit(0).cast("long"))
    filled = list(dict.fromkeys(e[0] for e in edges))
    counts = (
        clean.select(*places)
        .unpivot([], filled, "column", "bin")
        .where("bin IS NOT NULL")
        .groupBy("column", "bin")
        .agg(F.count("*").alias("n"))
    )
    # At most ``bins`` rows per column on both sides.
    return frame.join(F.broadcast(counts), ["column", "bin"], "left").select(
        "column", "bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def widest_categorical(df: DataFrame, typed: DataFrame) -> list[str]:
    """Categorical columns of a profile, most distinct values first (ties in table order)."""
    found = typed.where("role = 'categorical'").select("column", "n_unique").collect()
    return [r["column"] for r in sorted(found, key=lambda r: (-r["n_unique"], df.columns.index(r["column"])))]


def top_values(df: DataFrame, columns: Sequence[str] | None = None, max_cols: int = 3, k: int = 15) -> DataFrame:
    """``(column, rank, value, n)``: the most frequent values of the widest categorical columns."""
    if columns is None:
        columns = widest_categorical(df, open_types(df))
    columns = list(columns)[:max_cols]
    if not columns:
        return _rows(df, [], "column string, rank int, value string, n bigint")
    clean = nan_to_null(df)
    texts = clean.select(*[quoted(c).cast("string").alias(c) for c in columns])
    cells = texts.unpivot([], columns, "column", "value").where("value IS NOT NULL")
    counts = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    order = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "column", "rank", "value", "n"
    )


def daily_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, day, n)`` for every datetime column; days without rows are absent."""
    if columns is None:
        columns = [c for c, role in roles_by_column(df).items() if role == "datetime"]
    if not columns:
        return _rows(df, [], "column string, day date, n bigint")
    dates = df.select(*[F.to_date(to_ts(df, c)).alias(c) for c in columns])
    days = dates.unpivot([], list(columns), "column", "day").where("day IS NOT NULL")
    return days.groupBy("column", "day").agg(F.count("*").alias("n")).orderBy("column", "day")


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(x, y, r)``: Pearson over the rows where both are present; NULL where undefined."""
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return _rows(df, [], "x string, y string, r double")
    found = correlations(nan_to_null(df), columns, [_number(c) for c in columns])
    return found.withColumn("r", F.round("r", 4))


def iqr_fences(known: Quartiles) -> dict[str, tuple[float, float, float, float]]:
    """Column -> (q1, q3, lower, upper); columns without values are left out."""
    fences = {}
    for c, (q1, _, q3) in known.items():
        if q1 is not None:
            reach = 1.5 * (q3 - q1)
            fences[c] = (q1, q3, q1 - reach, q3 + reach)
    return fences


def _outside(v: Column, lower: float, upper: float) -> Column:
    return (v < F.lit(lower)) | (v > F.lit(upper))


def _outside_per_column(clean: DataFrame, fences: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    """``(column, n_outliers, n_rows)``: one aggregate over long rows, however many columns there are."""
    limits = _rows(clean, [(c, f[2], f[3]) for c, f in fences.items()], "column string, lower double, upper double")
    numbers = clean.select(*[_number(c).alias(c) for c in fences])
    cells = numbers.unpivot([], list(fences), "column", "value")
    # One row per column is joined.
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    counts = cells.join(F.broadcast(limits), "column").groupBy("column").agg(F.count_if(outside).alias("n_outliers"), F.count("*").alias("n_rows"))
    names = limits.select("column")
    return names.join(F.broadcast(counts), "column", "left").select(
        "column", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_outliers", "n_rows")])


def _outlier_counts(clean: DataFrame, fences: dict[str, tuple[float, float, float, float]]) -> dict[str, int]:
    return {c: n for c, n, _ in _outside_per_column(clean, fences).collect()}


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, known: Quartiles | None = None) -> DataFrame:
    """``(column, q1, q3, lower, upper, n_outliers, pct)``: values strictly outside
    q1 - 1.5 IQR .. q3 + 1.5 IQR, and their share of all rows, per numeric column.
    """
    clean = nan_to_null(df)
    fences = iqr_fences(known or quartiles(df, columns))
    if not fences:
        schema = "column string, q1 double, q3 double, lower double, upper double, n_outliers bigint, pct double"
        return _rows(df, [], schema)
    pct = F.round(F.try_divide(F.col("n_outliers") * 100.0, F.col("n_rows")), 2).alias("pct")
    table = _outside_per_column(clean, fences).select("column", "n_outliers", pct)
    names = ("q1", "q3", "lower", "upper")
    return _with_quantiles(table, {c: list(f) for c, f in fences.items()}, names, 4).select("column", *names, "n_outliers", "pct")


def outlier_examples(
    df: DataFrame,
    order_by: str,
    columns: Sequence[str] | None = None,
    top: int = 3,
    k: int = 5,
    known: Quartiles | None = None,
) -> DataFrame:
    """``(column, n_outliers, lower, upper, rank, value)``: first k outliers of the worst columns.

    Without any outlier every column is listed once with its normal range.
    """
    schema = "column string, n_outliers bigint, lower double, upper double"
    clean = nan_to_null(df)
    fences = iqr_fences(known or quartiles(df, columns))
    if not fences:
        return _rows(df, [], schema + ", rank int, value double")
    counts = _outlier_counts(clean, fences)
    worst = sorted((c for c in fences if counts[c] > 0), key=lambda c: -counts[c])[:top]
    listed = _rows(df, [(c, counts[c], *fences[c][2:]) for c in worst or fences], schema)
    listed = listed.select("column", "n_outliers", half_even(F.col("lower"), 4).alias("lower"), half_even(F.col("upper"), 4).alias("upper"))
    if not worst:
        return listed.withColumns({"rank": F.lit(None).cast("int"), "value": F.lit(None).cast("double")})
    cells = F.array_compact(
        F.array(*[
            F.when(_outside(_number(c), *fences[c][2:]), F.struct(F.lit(c).alias("column"), _number(c).alias("value")))
            for c in worst
        ])
    )
    order = W.partitionBy("column").orderBy("_order", "value")
    examples = (
        clean.select(F.col(order_by).alias("_order"), F.inline(cells))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .drop("_order")
    )
    # At most ``top`` rows on the listed side.
    return examples.join(F.broadcast(listed), "column").select(*listed.columns, "rank", "value")


def missing_summary(df: DataFrame, profiled: DataFrame | None = None) -> DataFrame:
    """``(column, n_null, null_pct)`` of the columns with missing values, most first.

    Taken from a known profile, or from one aggregation.
    """
    if profiled is None:
        clean = nan_to_null(df)
        n = [F.count_if(quoted(c).isNull()) for c in df.columns]
        wide = clean.agg(
            *[x.alias(f"n_null_{i}") for i, x in enumerate(n)],
            *[F.round(F.try_divide(x * 100.0, F.count("*")), 2).alias(f"null_pct_{i}") for i, x in enumerate(n)],
        )
        profiled = unstack(wide, df.columns, ("n_null", "null_pct"), "n_null:bigint,null_pct:double")
    return profiled.select("column", "n_null", "null_pct").where("n_null > 0").orderBy(F.desc("n_null"), "column")


def box_stats(df: DataFrame, columns: Sequence[str] | None = None, known: Quartiles | None = None) -> DataFrame:
    """``(column, q1, median, q3, whisker_low, whisker_high, mean, std)``; whiskers are
    the last values inside the fences.
    """
    clean = nan_to_null(df)
    filled = {c: q for c, q in (known or quartiles(df, columns)).items() if q[0] is not None}
    fields = ("q1", "median", "q3", "whisker_low", "whisker_high", "mean", "std")
    if not filled:
        return _rows(df, [], "column string, " + ", ".join(f"{f} double" for f in fields))
    reach = {c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, _, q3) in filled.items()}
    # One row per column is joined.
    limits = F.broadcast(_rows(df, [(c, *x) for c, x in reach.items()], "column string, lowest double, highest double"))
    inside = F.col("value").between(F.col("lowest"), F.col("highest"))
    kept = F.when(inside, F.col("value"))
    summary = _unpivot(clean, list(filled)).join(limits, "column").groupBy("column").agg(
        half_even(F.min(kept), 4).alias("whisker_low"),
        half_even(F.max(kept), 4).alias("whisker_high"),
        half_even(F.avg("value"), 4).alias("mean"),
        half_even(F.stddev_samp("value"), 4).alias("std"),
    )
    return _with_quantiles(summary, filled, fields[:3], 4).select("column", *fields)
