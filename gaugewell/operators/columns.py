"""Missingness by column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.base import Analyzer, Result
from gaugewell.functions.missing import flag

#: Reports over a sample: mean, median, std (n - 1), min, max and upper percentiles with linear interpolation.
METRICS = ("mean", "median", "std", "min", "max", "p90", "p95", "p99")


def spread(df: DataFrame, column: str) -> dict:
    """Aggregates of METRICS over a column, 0.0 for an empty table; std of one row is NULL."""
    c = F.col(column)
    some = lambda x: F.when(F.count("*") == 0, F.lit(0.0)).otherwise(x.cast("double"))
    share = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    made = {"mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c)} | {k: F.percentile(c, p) for k, p in share.items()}
    return {m: some(made[m]) for m in METRICS}


class ColumnsMissingness(Analyzer):
    id = "dataset.missingness.rates.columns"
    capability = "missingness.column_rates"
    provides = ("missingness.column_rates",)

    def __init__(self, df: DataFrame):
        self.df = df

    def counts(self) -> DataFrame:
        """column, missing_count, n, dtype: one aggregation for all columns, then a row for each."""
        df = self.df
        if not df.columns:
            return df.sparkSession.createDataFrame([], "column string, missing_count long, n long, dtype string")
        sums = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(flag(df, c)), F.lit(0)).alias(f"m{i}") for i, c in enumerate(df.columns)])
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"), F.lit(t).alias("dtype")) for i, (c, t) in enumerate(df.dtypes)]
        return sums.select("n", F.explode(F.array(*cells)).alias("x")).select("x.column", "x.missing_count", "n", "x.dtype")

    def summary(self) -> Result:
        """column, missing_count, missing_rate, dtype; highest rate first, then by name."""
        rate = F.when(F.col("n") > 0, F.col("missing_count") / F.col("n")).otherwise(F.lit(0.0))
        out = self.counts().select("column", "missing_count", rate.alias("missing_rate"), "dtype")
        return Result(out.orderBy(F.desc("missing_rate"), "column"), out.orderBy("missing_rate", "column"))

    def stats(self) -> Result:
        """metric, rates, counts: METRICS across the columns."""
        s = self.summary().df
        one = s.agg(*[v.alias(f"r_{k}") for k, v in spread(s, "missing_rate").items()], *[v.alias(f"c_{k}") for k, v in spread(s, "missing_count").items()])
        rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("metric"), F.col(f"r_{m}").alias("rates"), F.col(f"c_{m}").alias("counts")) for i, m in enumerate(METRICS)])
        out = one.select(F.explode(rows).alias("x")).select("x.i", "x.metric", "x.rates", "x.counts")
        return Result(out.orderBy("i").drop("i"), out.orderBy(F.desc("i")).drop("i"))
