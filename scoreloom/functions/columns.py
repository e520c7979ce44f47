"""Column helpers: folding of missing values, label filters, safe arithmetic, report keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1e-8
MISSING = "Missing"
TAG_ORDER = ("train", "test", "oot", "oos")


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(df: DataFrame, name: str, booleans: bool = False) -> bool:
    kind = df.schema[name].dataType
    return isinstance(kind, T.NumericType) or (booleans and isinstance(kind, T.BooleanType))


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns in schema order; booleans are not numeric here."""
    return [c for c in (columns if columns is not None else df.columns) if is_numeric(df, c)]


def number(column: Column) -> Column:
    """As a double; what can't be read as a number, and NaN, is null."""
    x = column.try_cast("double")
    return F.when(~F.isnan(x), x)


def numeric(df: DataFrame, name: str) -> Column:
    """A column of df as a double or null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return col(name).cast("double")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return col(name).cast("double")
    return number(col(name))


def category(df: DataFrame, name: str) -> Column:
    """A column as text, missing values as "Missing"."""
    kind = df.schema[name].dataType
    text = col(name).cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(~F.isnan(col(name)), text)
    return F.coalesce(text, F.lit(MISSING))


def label(df: DataFrame, name: str) -> Column:
    """1, 0 or null for anything else, grey samples included."""
    x = numeric(df, name)
    return F.when(x.isin(0.0, 1.0), x.cast("int"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def tag_text(column: Column) -> Column:
    """A sample set's name; null and blank become "None"."""
    return F.coalesce(F.nullif(F.trim(column.cast("string")), F.lit("")), F.lit("None"))


def month_text(df: DataFrame, name: str) -> Column:
    """YYYYMM of dates; texts are cut to 10 characters and read as a date, else their first six digits, else as they stand; null: ""."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.date_format(col(name), "yyyyMM"), F.lit(""))
    text = F.substring(F.trim(col(name).cast("string")), 1, 10)
    read = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM", "yyyy/MM")])
    digits = F.regexp_extract(text, r"^(\d{6})", 1)
    return F.coalesce(F.date_format(read, "yyyyMM"), F.nullif(digits, F.lit("")), text, F.lit(""))


def date_range(column: Column) -> Column:
    """An aggregate: YYYYMMDD-YYYYMMDD of the first and last readable date, "" without one."""
    text = F.substring(F.trim(column.cast("string")), 1, 10)
    day = F.to_date(F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM", "yyyy/MM")]))
    return F.concat_ws("-", F.date_format(F.min(day), "yyyyMMdd"), F.date_format(F.max(day), "yyyyMMdd"))


def tag_rank(column: Column) -> Column:
    """Place of a sample set in reports: train, test, oot, oos, then others."""
    out = F.lit(len(TAG_ORDER))
    for i, name in reversed(list(enumerate(TAG_ORDER))):
        out = F.when(F.lower(column.cast("string")) == name, i).otherwise(out)
    return out


def month_rank(column: Column) -> Column:
    """Text by which months are sorted: null and "" last, unreadable ones just before."""
    text = F.trim(column.cast("string"))
    return F.when(column.isNull() | (text == ""), F.lit("999999")).when(text.rlike(r"^\d{6}$"), text).otherwise(F.concat(F.lit("999998"), text))


def report_order(df: DataFrame, leading: Sequence[str] = (), tag: str | None = None, month: str | None = None) -> DataFrame:
    """Sorted by leading columns, sample set and month."""
    keys = [col(c) for c in leading]
    keys += [tag_rank(col(tag)), col(tag)] if tag else []
    keys += [month_rank(col(month)), col(month)] if month else []
    return df.orderBy(*keys) if keys else df


def positive(df: DataFrame, columns: Sequence[str]) -> Column:
    """All the columns are numbers, finite and above 0."""
    out = F.lit(True)
    for c in columns:
        x = numeric(df, c)
        out = out & F.coalesce((x > 0) & (x < float("inf")), F.lit(False))
    return out
