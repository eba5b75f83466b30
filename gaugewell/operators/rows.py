"""Missingness by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.base import Analyzer, Result, require_column, require_share
from gaugewell.functions.missing import col, missing, missing_in_row
from gaugewell.operators.columns import spread


class RowsMissingness(Analyzer):
    """Rows are named by ``id_col``, which isn't counted itself. All counts are narrow expressions: no shuffle until the last sum."""

    id = "dataset.missingness.rates.rows"
    capability = "missingness.row_rates"
    provides = ("missingness.row_rates",)

    def __init__(self, df: DataFrame, id_col: str | None = None):
        require_column(df, id_col, "id_col")
        self.df, self.id_col = df, id_col
        self.columns = [c for c in df.columns if c != id_col]

    def _id(self) -> list[Column]:
        return [col(self.id_col)] if self.id_col else []

    def n_cols(self) -> int:
        return len(self.columns)

    def _count(self) -> Column:
        return missing_in_row(self.df, self.columns)

    def _rate(self) -> Column:
        return self._count() / F.lit(self.n_cols()) if self.columns else F.lit(0.0)

    def mask(self) -> DataFrame:
        return self.df.select(*self._id(), *[missing(self.df, c).alias(c) for c in self.columns])

    def counts(self) -> DataFrame:
        return self.df.select(*self._id(), self._count().alias("missing_count"))

    def rates(self) -> DataFrame:
        return self.df.select(*self._id(), self._rate().alias("missing_rate"))

    def _chosen(self, condition: Column, sample_size: int | None, about: dict) -> Result:
        rows = self.df.where(condition)
        out = self.df.agg(F.count_if(condition).alias("count"), F.count("*").alias("total_rows"))
        out = out.select("count", *[F.lit(v).alias(k) for k, v in about.items()], "total_rows")
        ids = rows.select(*self._id()).orderBy(*self._id()) if self.id_col else None
        chart = out.select(F.explode(F.array(F.struct(F.lit("matching").alias("part"), F.col("count").alias("rows")), F.struct(F.lit("others").alias("part"), (F.col("total_rows") - F.col("count")).alias("rows")))).alias("x")).select("x.*")
        return Result(out, chart, {"indices": ids if sample_size is None or ids is None else ids.limit(sample_size)})

    def full_missing(self, sample_size: int | None = None) -> Result:
        """Rows with nothing in them: df has the count (never cut), extra['indices'] the first sample_size ids."""
        found = self._chosen(self._rate() == 1.0, sample_size, {})
        return Result(found.df.select("count"), found.df.select("count"), found.extra)

    def missing_above(self, threshold: float, sample_size: int | None = None) -> Result:
        require_share(threshold, "threshold")
        return self._chosen(self._rate() >= threshold, sample_size, {"threshold": float(threshold), "direction": "above"})

    def missing_below(self, threshold: float, sample_size: int | None = None) -> Result:
        require_share(threshold, "threshold")
        return self._chosen(self._rate() <= threshold, sample_size, {"threshold": float(threshold), "direction": "below"})

    def completeness(self) -> Result:
        """n_missing_fields, n_rows; observed values only."""
        out = self.df.groupBy(self._count().alias("n_missing_fields")).agg(F.count("*").alias("n_rows")).orderBy("n_missing_fields")
        return Result(out, out)

    def summary(self, thresholds: dict[str, float] | None = None) -> Result:
        """One row: total_rows, full_missing_rows, and missing_rows_above / missing_rows_below where a threshold is given."""
        made = [F.count("*").alias("total_rows"), F.count_if(self._rate() == 1.0).alias("full_missing_rows")]
        for k, compare in (("above", lambda t: self._rate() >= t), ("below", lambda t: self._rate() <= t)):
            if thresholds and thresholds.get(k) is not None:
                require_share(thresholds[k], f"thresholds[{k!r}]")
                made.append(F.count_if(compare(thresholds[k])).alias(f"missing_rows_{k}"))
        out = self.df.agg(*made)
        return Result(out, out.unpivot([], out.columns, "measure", "rows"))

    def stats(self) -> Result:
        """One row: METRICS of the row rates."""
        r = self.rates()
        out = r.agg(*[v.alias(k) for k, v in spread(r, "missing_rate").items()])
        return Result(out, out.unpivot([], out.columns, "metric", "rate"))
