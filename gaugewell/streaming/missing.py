"""Missingness of streams, as counts that are added up.

The whole stream's counts are one row of state, its reports are written in complete mode;
windows of event time are a row of state each, which goes when the watermark has passed
it, and are written in append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.missing import flag, missing_in_row
from gaugewell.operators.columns import ColumnsMissingness


def column_missingness(stream: DataFrame) -> DataFrame:
    """column, missing_count, n, missing_rate of all rows so far."""
    return ColumnsMissingness(stream).counts().select("column", "missing_count", "n", (F.col("missing_count") / F.greatest("n", F.lit(1))).alias("missing_rate"))


def row_completeness(stream: DataFrame, id_col: str | None = None) -> DataFrame:
    """n_missing_fields, n_rows of all rows so far."""
    columns = [c for c in stream.columns if c != id_col]
    return stream.groupBy(missing_in_row(stream, columns).alias("n_missing_fields")).agg(F.count("*").alias("n_rows"))


def windowed_column_missingness(stream: DataFrame, time_col: str, window: str, late: str) -> DataFrame:
    """start, end, column, missing_count, n of each window of event time; rows that come later than ``late`` don't count."""
    columns = [c for c in stream.columns if c != time_col]
    sums = [F.sum(flag(stream, c)).alias(f"m{i}") for i, c in enumerate(columns)]
    by = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w")).agg(F.count("*").alias("n"), *sums)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count")) for i, c in enumerate(columns)])
    return by.select("w.start", "w.end", "n", F.explode(cells).alias("x")).select("start", "end", "x.column", "x.missing_count", "n")
