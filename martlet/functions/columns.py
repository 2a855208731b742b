"""Scalar expressions shared by the operators. Everything stays inside Spark's code generation."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_as_null(value: Column | str) -> Column:
    """Null for strings that are empty or only spaces; other values are kept untrimmed."""
    c = as_col(value)
    return F.when(F.trim(c) != "", c)


def midnight(day: dt.date, kind: str | T.DataType = "timestamp_ntz") -> Column:
    """Start of a day as a literal of a timestamp type, whatever the time zones of session and driver."""
    return F.lit(f"{day.isoformat()} 00:00:00").cast(kind)


def date_key(value: Column | str) -> Column:
    """Integer ``yyyymmdd`` key of a date or timestamp."""
    c = as_col(value)
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def hour_boundaries(start: Column | str, end: Column | str) -> Column:
    """Number of full clock hours crossed between two timestamps (10:59 to 11:01 counts as 1)."""
    a, b = as_col(start), as_col(end)
    day_hours = F.datediff(F.to_date(b), F.to_date(a)).cast("long") * 24
    return day_hours + F.hour(b) - F.hour(a)


def divide_or_null(numerator: Column | str, denominator: Column | str) -> Column:
    """Null instead of an error when the denominator is zero or null."""
    return F.try_divide(as_col(numerator), as_col(denominator))


def percent_of(part: Column | str, whole: Column | str) -> Column:
    return divide_or_null(as_col(part) * 100.0, whole)


def underscore_name(name: str) -> str:
    """Column name with spaces replaced, as used for exported tables."""
    return name.replace(" ", "_")


def plain_name(name: str) -> str:
    """Column name reduced to letters, digits and underscores, as used for model training."""
    return re.sub(r"[^A-Za-z0-9_]+", "_", name)


def week_end_sunday(value: Column | str) -> Column:
    """Sunday that closes the Monday-to-Sunday week; a Sunday is its own label."""
    return F.next_day(F.date_sub(F.to_date(as_col(value)), 1), "SUN")


def fill_template(template: str, **values: Column | str) -> Column:
    """Replace ``{name}`` placeholders of a prompt template by column values."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = []
    for position, piece in enumerate(pieces):
        if position % 2 == 0:
            parts.append(F.lit(piece))
        elif piece in values:
            parts.append(F.coalesce(as_col(values[piece]).cast("string"), F.lit("")))
        else:
            raise ValueError(f"no value for placeholder {{{piece}}}")
    return F.concat(*parts)


def sample_skewness(value: Column | str) -> Column:
    """Bias-corrected skewness aggregate (Spark's built-in is the population value)."""
    c = as_col(value)
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two numeric arrays, null when either has no length."""
    x, y = as_col(a).cast("array<double>"), as_col(b).cast("array<double>")

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda acc, t: acc + t)

    return divide_or_null(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
