"""The small DataFrames behind the charts; drawing them is up to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_overview(dups) -> DataFrame:
    """part, rows: duplicate and unique rows."""
    n, d = F.col("n_rows"), F.col("n_duplicate_rows")
    return dups.duplicate_rate().select(F.explode(F.array(_part("duplicate", d), _part("unique", n - d))).alias("x")).select("x.*")


def group_sizes(dups, top_n: int = 20) -> DataFrame:
    """The largest duplicate groups."""
    return dups.duplicate_groups().limit(top_n)


def groups_by_split(dups) -> DataFrame:
    """part, rows: duplicate groups within a split and across splits."""
    if not dups.split_col:
        raise ValueError("groups_by_split needs split_col")
    return _two(dups.flagged_groups(), F.col("two_splits"), "cross_split", "within_split")


def groups_by_conflict(dups) -> DataFrame:
    """part, rows: duplicate groups with conflicting and with consistent labels."""
    if not dups.label_col:
        raise ValueError("groups_by_conflict needs label_col")
    return _two(dups.flagged_groups(), F.col("two_labels"), "conflicting", "consistent")


def low_density_share(density) -> DataFrame:
    """part, rows: rows below and above the low-density threshold."""
    n, low = F.col("n_rows"), F.col("n_low")
    return density.low_density_count().select(F.explode(F.array(_part("low_density", low), _part("others", n - low))).alias("x")).select("x.*")


def density_2d(density, dims, resolution: int = 100, max_points: int = 2000, seed: int = 0) -> dict[str, DataFrame]:
    """The grid of two columns, and a sample of the points over it."""
    points = density.df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(density.id_col).cast("string")).cast("binary")), density.id_col).limit(max_points).select(*dims)
    return {"grid": density.density_grid(dims, resolution), "points": points}


def low_density_table(density, top_n: int = 15) -> DataFrame:
    return density.low_density_regions().limit(top_n)


def pattern(clusters, top_n: int = 20, **how) -> DataFrame:
    """Shares of missing values of the largest clusters."""
    return clusters.pattern_matrix(**how).where(F.col("cluster_id") < top_n)


def dendrogram(clusters, **how) -> DataFrame:
    """a, b, height, size of the merges."""
    merges = clusters.dendrogram(**how).linkage
    rows = [(int(a), int(b), float(h), int(n)) for a, b, h, n in merges]
    return clusters.df.sparkSession.createDataFrame(rows, "a int, b int, height double, size int")


def _part(name, rows):
    return F.struct(F.lit(name).alias("part"), rows.cast("long").alias("rows"))


def _two(df, condition, yes, no):
    counts = df.agg(F.count_if(condition).alias("y"), F.count_if(~condition).alias("n"))
    return counts.select(F.explode(F.array(_part(yes, F.col("y")), _part(no, F.col("n")))).alias("x")).select("x.*")
