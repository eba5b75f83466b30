"""Missingness as column expressions: NULL, and NaN in floating columns, are missing; infinities and '' are present."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def missing(df: DataFrame, column: str) -> Column:
    """True where the value is missing."""
    c = col(column)
    return c.isNull() | F.isnan(c) if isinstance(_type(df, column), (T.FloatType, T.DoubleType)) else c.isNull()


def canon(df: DataFrame, column: str) -> Column:
    """The value with NaN as NULL, so that missing equals missing in groups and null-safe comparisons."""
    c = col(column)
    return F.when(~F.isnan(c), c) if isinstance(_type(df, column), (T.FloatType, T.DoubleType)) else c


def flag(df: DataFrame, column: str) -> Column:
    return missing(df, column).cast("int")


def missing_in_row(df: DataFrame, columns: list[str]) -> Column:
    """Number of missing values of the columns in a row."""
    return reduce(lambda a, b: a + b, [flag(df, c) for c in columns], F.lit(0))


def is_numeric(df: DataFrame, column: str) -> bool:
    """Numbers and booleans; not dates, intervals or strings."""
    return isinstance(_type(df, column), (T.NumericType, T.BooleanType))


def number(df: DataFrame, column: str) -> Column:
    """A numeric column as a double, missing as NULL."""
    c = canon(df, column)
    return (c.cast("int") if isinstance(_type(df, column), T.BooleanType) else c).cast("double")
