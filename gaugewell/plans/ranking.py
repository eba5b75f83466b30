"""Global ranks and quantiles without a single-task window."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.sources.shared import materialise

#: Cells of a histogram, and rows that come to the driver at most.
CELLS, FEW = 4096, 10_000


def with_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its row number (from 0) in the given order; the order should have no ties.

    Rows are dealt out by range; each part is numbered for itself and raised by the sizes
    of the parts before it, of which there are as many as partitions.
    """
    if not order:
        return df.withColumn(name, F.lit(0).cast("long"))
    dealt = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranks")
    before = Window.orderBy("__part")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    sizes = sizes.select("__part", (F.sum("__n").over(before) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(F.broadcast(sizes), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def quantiles(df: DataFrame, column: str, shares: list[float], weight: str | None = None) -> list[float | None]:
    """Exact quantiles of a column of doubles, linearly interpolated; nulls don't count.

    A row counts as often as its weight says, a whole number from 1 on. The range that holds a
    quantile is narrowed by histograms of CELLS cells, until no more than FEW rows or one
    value are in it; only counts and those rows come to the driver.
    """
    own = F.lit(1) if weight is None else F.col(weight)
    df = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"), own.cast("long").alias("w"))
    finite, total = F.col("x") > float("-inf"), F.coalesce(F.sum("w"), F.lit(0))
    n, none, rows, low, high = df.agg(total, F.coalesce(F.sum(F.when(~finite, F.col("w"))), F.lit(0)), F.count_if(finite), F.min(F.when(finite, F.col("x"))), F.max("x")).first()
    if not n:
        return [None for _ in shares]

    @cache
    def parts(a: float, b: float) -> list:
        width = b / CELLS - a / CELLS
        part = df.where((F.col("x") >= a) & (F.col("x") <= b))
        cell = F.least(F.lit(CELLS - 1), F.floor((F.col("x") - F.lit(a)) / F.lit(width))).cast("int")
        return part.groupBy(cell.alias("c")).agg(F.count("*").alias("rows"), F.sum("w").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("c").collect()

    @cache
    def few(a: float, b: float) -> list:
        return sorted(map(tuple, df.where((F.col("x") >= a) & (F.col("x") <= b)).collect()))

    def at(k: int) -> float:
        """The k-th value from 0 on."""
        if k < none:
            return float("-inf")
        a, b, before, inside = low, high, none, rows
        while inside > FEW and b / CELLS - a / CELLS > 0:
            for r in parts(a, b):
                if before + r["n"] > k:
                    a, b, inside = r["a"], r["b"], r["rows"]
                    break
                before += r["n"]
        if a == b:
            return a
        for x, w in few(a, b):
            before += w
            if before > k:
                return x

    out = []
    for share in shares:
        place = share * (n - 1)
        k = int(place)
        value = at(k)
        then = value if place == k else at(k + 1)
        # between equal values lies that value: interpolation may round beyond it
        out.append(value if value == then else (1 - (place - k)) * value + (place - k) * then)
    return out
