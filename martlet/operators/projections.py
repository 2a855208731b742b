"""Projections, filters and predicates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.functions.columns import as_col, midnight


def project(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Select expressions under new names: ``{alias: expression}``."""
    return df.select(*[as_col(c).alias(alias) for alias, c in columns.items()])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_cols(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def stamp(df: DataFrame, **literals: Any) -> DataFrame:
    """Add constant columns, for example a run time, model name and version."""
    return df.withColumns({name: v if isinstance(v, Column) else F.lit(v) for name, v in literals.items()})


def sql_transform(df: DataFrame, statement: str) -> DataFrame:
    """Apply ``SELECT ... FROM __THIS__`` as a pipeline stage would."""
    return SQLTransformer(statement=statement).transform(df)


def where_eq(df: DataFrame, column: str, value: Any) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def where_in(df: DataFrame, column: str, values: Iterable[Any] | DataFrame, negate: bool = False) -> DataFrame:
    """Membership test. A short literal list becomes ``IN``; a DataFrame of keys becomes a semi or anti join."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias(column))
        return df.join(keys, column, "left_anti" if negate else "left_semi")
    test = F.col(column).isin(*values)
    return df.filter(~test if negate else test)


def where_between(df: DataFrame, column: str, low: dt.date, high: dt.date) -> DataFrame:
    """Rows whose calendar day lies in ``[low, high]``, kept in a form the file scan can evaluate."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.DateType):
        return df.filter(c.between(F.lit(low), F.lit(high)))
    kind = df.schema[column].dataType
    return df.filter((c >= midnight(low, kind)) & (c < midnight(high + dt.timedelta(days=1), kind)))


def exclude_month(df: DataFrame, column: str, year: int, month: int, min_year: int | None = None) -> DataFrame:
    """Drop one (incomplete) month and, optionally, everything before ``min_year``."""
    c = F.col(column)
    kept = df if min_year is None else df.filter(F.year(c) >= min_year)
    return kept.filter(~((F.year(c) == year) & (F.month(c) == month)))


def drop_null(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=subset)


def since_days(df: DataFrame, column: str, days: int, as_of: Column) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; the day is passed in to keep results repeatable."""
    return df.filter(F.to_date(F.col(column)) >= F.date_sub(as_of, days))


def lookup(df: DataFrame, key: str, value: Any) -> DataFrame:
    """Point lookup by key; on a bucketed or sorted table only the matching files are read."""
    return df.filter(F.col(key) == F.lit(value))


def non_empty(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.coalesce(F.length(F.col(column)), F.lit(0)) > 0)


def where_prefix(df: DataFrame, column: str, prefix: Column | str) -> DataFrame:
    return df.filter(F.col(column).startswith(prefix))


def without_last_char(value: str) -> str:
    """Prefix used by the personal lookup: the id without its last character."""
    return value[:-1]


def facet_filter(
    df: DataFrame,
    category: str | None = None,
    low: float | None = None,
    high: float | None = None,
    in_stock: bool = False,
    columns: tuple[str, str, str] = ("category", "price", "stock"),
) -> DataFrame:
    """Catalog facets: category without regard to case, price range (no price, no match), stock on hand."""
    category_col, price_col, stock_col = (F.col(c) for c in columns)
    if category is not None and category != "All Categories":
        df = df.filter(F.lower(category_col) == category.lower())
    if low is not None and high is not None:
        df = df.filter((price_col != 0) & price_col.between(low, high))
    return df.filter(stock_col > 0) if in_stock else df


def text_search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows where any of the columns contains the text, without regard to case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False))
    return df.filter(hit)


_KINDS = {
    "number": (T.NumericType,),
    "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "category": (T.StringType, T.BooleanType),
}


def select_types(df: DataFrame, kinds: Iterable[str], drop_all_null: bool = False) -> DataFrame:
    """Keep columns of the given kinds; optionally drop those without any value (one pass for all)."""
    wanted = tuple(t for kind in kinds for t in _KINDS[kind])
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, wanted)]
    if drop_all_null and names:
        filled = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in names]).first()
        names = [c for c in names if filled[c]]
    return df.select(*names)


def cast_cols(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns; values that do not fit become null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})
