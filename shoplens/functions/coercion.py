"""Lenient conversions: what cannot be read becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dates begin with one of these; the rest (a time of day) is left to the cast.
_ISO = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]|\s*$)"
_REORDERED = (
    (r"^\s*(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3"),
    (r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2"),
    (r"^\s*(\d{4})(\d{2})(\d{2})\s*$", "$1-$2-$3"),
)
# Month names by their first letters.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_DAY_MONTH = r"^\s*(\d{1,2})[-/. ]([A-Za-z]{3})[a-z]*\.?[-/., ]+(\d{4})(.*)$"
_MONTH_DAY = r"^\s*([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})(.*)$"
_HALF_DAY = r"^(.*\D)(\d{1,2})(:\d{2}(?::\d{2})?)\s*([AaPp])\.?[Mm]\.?\s*$"
# A cast reads "1d" and "1f" as numbers.
_TYPE_SUFFIX = r"[\d.][dDfF]\s*$"


def _typed(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    return F.col(f"`{name}`"), df.schema[name].dataType


def _in_24_hours(c: Column) -> Column:
    """``3:04 PM`` as ``15:04``; a text without such a time stays."""
    hour = F.regexp_extract(c, _HALF_DAY, 2).try_cast("int") % 12
    late = F.when(F.lower(F.regexp_extract(c, _HALF_DAY, 4)) == "p", 12).otherwise(0)
    time = F.concat(F.lpad((hour + late).cast("string"), 2, "0"), F.regexp_extract(c, _HALF_DAY, 3))
    return F.when(c.rlike(_HALF_DAY), F.concat(F.regexp_extract(c, _HALF_DAY, 1), time)).otherwise(c)


def _with_month_name(c: Column, pattern: str, day: int, month: int) -> Column:
    at = F.instr(F.lit(_MONTHS), F.lower(F.regexp_extract(c, pattern, month)))
    number = F.when(at % 3 == 1, ((at + 2) / 3).cast("int"))
    return F.concat(F.regexp_extract(c, pattern, 3), F.lit("-"), number, F.lit("-"), F.regexp_extract(c, pattern, day),
                    F.regexp_extract(c, pattern, 4))


def _string_to_ts(text: Column) -> Column:
    def read(c: Column) -> Column:
        result = F.when(c.rlike(_ISO), c.try_cast("timestamp_ntz"))
        for pattern, iso in _REORDERED:
            result = result.when(c.rlike(pattern), F.regexp_replace(c, pattern, iso).try_cast("timestamp_ntz"))
        for pattern, day, month in ((_DAY_MONTH, 1, 2), (_MONTH_DAY, 2, 1)):
            result = result.when(c.rlike(pattern), _with_month_name(c, pattern, day, month).try_cast("timestamp_ntz"))
        return result

    # An array of one element names the text with its 24-hour time; written out in every branch it is too much code to compile.
    return F.element_at(F.transform(F.array(_in_24_hours(text)), read), 1)


def to_ts(df: DataFrame, name: str) -> Column:
    """Dates from texts and from whole numbers of the form yyyymmdd."""
    c, dtype = _typed(df, name)
    if isinstance(dtype, T.IntegralType):
        return F.when(c.between(10_000_101, 99_991_231), _string_to_ts(c.cast("string")))
    if isinstance(dtype, T.StringType):
        return _string_to_ts(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def to_num(df: DataFrame, name: str) -> Column:
    c, dtype = _typed(df, name)
    if isinstance(dtype, T.StringType):
        c = F.when(~c.rlike(_TYPE_SUFFIX), c.try_cast("double"))
    if isinstance(dtype, (T.StringType, T.FloatType, T.DoubleType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    return F.lit(None).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing; Spark itself keeps it as the largest number."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns(
        {n: F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")) for n in floats}
    )


def calendar(df: DataFrame, date: str) -> DataFrame:
    """Add ``month`` (yyyy-MM), ``day`` and ``weekday`` (Monday is 0)."""
    d = F.col(date)
    return df.withColumns(
        {
            "month": F.date_format(d, "yyyy-MM"),
            "day": F.to_date(d),
            "weekday": F.weekday(d),
        }
    )
