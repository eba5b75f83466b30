"""What goes missing together, and what missingness goes along with."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.base import Result, require_column
from gaugewell.functions.missing import canon, flag, is_numeric, number
from gaugewell.functions.special import chi2_upper, t_two_sided

#: Expressions in one aggregation; more columns are done in several passes.
BATCH = 200
#: Characters beyond which a category is told apart by its digest.
LONG_VALUE = 64
_SCHEMA = "missing_column string, compared_to string, compared_type string, statistic double, p_value double, method string"


class MissingnessCorrelation:
    """Statistics come from sums over all rows; what reaches the driver has a row per pair of columns."""

    def __init__(self, df: DataFrame, id_col: str | None = None, min_valid: int = 3):
        require_column(df, id_col, "id_col")
        self.df, self.min_valid = df, min_valid
        self.columns = [c for c in df.columns if c != id_col]
        self._missing: dict[str, int] | None = None

    def mask(self) -> DataFrame:
        return self.df.select(*[(flag(self.df, c) == 1).alias(c) for c in self.columns])

    def _sums(self, wanted: dict, df: DataFrame | None = None) -> dict:
        """Values of named aggregates, in passes of BATCH."""
        out, names = {}, list(wanted)
        for a in range(0, len(names), BATCH):
            some = names[a : a + BATCH]
            row = (self.df if df is None else df).agg(*[wanted[k].alias(f"x{i}") for i, k in enumerate(some)]).first()
            out |= {k: row[i] for i, k in enumerate(some)}
        return out

    def _missing_counts(self) -> dict[str, int]:
        if self._missing is None:
            got = self._sums({c: F.sum(flag(self.df, c)) for c in self.columns} | {None: F.count("*")})
            self.n = got.pop(None)
            self._missing = {c: v or 0 for c, v in got.items()}
        return self._missing

    def missing_missing_corr(self) -> Result:
        """column_a, column_b, corr: Pearson's r of the indicators of all columns that vary, rounded to 3 places."""
        counts = self._missing_counts()
        vary = [c for c in self.columns if 0 < counts[c] < self.n]
        spark, schema = self.df.sparkSession, "column_a string, column_b string, corr double"
        if len(vary) < 2:
            return Result(spark.createDataFrame([], schema))
        pairs = [(a, b) for i, a in enumerate(vary) for b in vary[i + 1 :]]
        both = self._sums({p: F.sum(flag(self.df, p[0]) * flag(self.df, p[1])) for p in pairs})
        n, rows = self.n, [(c, c, 1.0) for c in vary]
        for (a, b), x in both.items():
            r = (n * x - counts[a] * counts[b]) / math.sqrt(counts[a] * (n - counts[a]) * counts[b] * (n - counts[b]))
            rows += [(a, b, round(r, 3)), (b, a, round(r, 3))]
        out = spark.createDataFrame(sorted(rows), schema)
        return Result(out, out)

    def missing_observed_corr(self) -> Result:
        """Every column with missing values against every other column's observed values."""
        counts = self._missing_counts()
        targets = [c for c in self.columns if counts[c] > 0]
        return self._compared([(t, c) for t in targets for c in self.columns if c != t])

    def missing_target_corr(self, target: str) -> Result:
        """The missingness of one column against every other column's observed values."""
        require_column(self.df, target, "target")
        return self._compared([(target, c) for c in self.columns if c != target])

    def _compared(self, pairs: list[tuple[str, str]]) -> Result:
        rows = self._point_biserial([p for p in pairs if is_numeric(self.df, p[1])]) + self._cramers_v([p for p in pairs if not is_numeric(self.df, p[1])])
        rows.sort(key=lambda r: (r[4], r[0], r[1]))
        out = self.df.sparkSession.createDataFrame(rows, _SCHEMA)
        size = F.abs("statistic") / F.max(F.abs("statistic")).over(_everything())
        return Result(out, out.select("*", (F.col("p_value") < 0.05).alias("significant"), size.alias("size")))

    def _point_biserial(self, pairs):
        df = self.df
        numeric = sorted({c for _, c in pairs})
        if not numeric:
            return []
        means = self._sums({c: F.avg(number(df, c)) for c in numeric})
        wanted = {}
        for c in numeric:  # centred, so that the sums of squares don't cancel
            v = number(df, c) - F.lit(means[c] or 0.0)
            wanted |= {("n", c): F.count(v), ("v", c): F.sum(v), ("vv", c): F.sum(v * v)}
        for t, c in pairs:
            v = number(df, c) - F.lit(means[c] or 0.0)
            wanted |= {("m", t, c): F.sum(F.when(v.isNotNull(), flag(df, t))), ("mv", t, c): F.sum(v * flag(df, t))}
        got = self._sums(wanted)
        rows = []
        for t, c in pairs:
            n, v, vv, m, mv = (got[k] or 0 for k in (("n", c), ("v", c), ("vv", c), ("m", t, c), ("mv", t, c)))
            under = (n * m - m * m) * (n * vv - v * v)
            if n < self.min_valid or under <= 0 or not math.isfinite(under):
                continue
            r = max(-1.0, min(1.0, (n * mv - m * v) / math.sqrt(under)))
            p = t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)) if abs(r) < 1 else math.inf, n - 2) if n > 2 else 1.0
            rows.append((t, c, "numeric", round(r, 3), round(p, 4), "point_biserial"))
        return rows

    def _cramers_v(self, pairs):
        """2 x C tables of all pairs from one grouping by (column, value); Yates' correction if C = 2."""
        df = self.df
        if not pairs:
            return []
        columns, targets = sorted({c for _, c in pairs}), sorted({t for t, _ in pairs})
        # long values travel as digests
        short = lambda v: F.when(F.length(v) > LONG_VALUE, F.sha2(v.cast("binary"), 256)).otherwise(v)
        cells = F.array(*[F.struct(F.lit(c).alias("c"), short(canon(df, c).cast("string")).alias("v")) for c in columns])
        long = df.select(*[flag(df, t).alias(f"m{i}") for i, t in enumerate(targets)], F.explode(cells).alias("x")).where("x.v IS NOT NULL")
        table = long.groupBy("x.c", "x.v").agg(F.count("*").alias("n"), *[F.sum(f"m{i}").alias(f"m{i}") for i in range(len(targets))])
        totals = table.groupBy(F.col("c").alias("t_c")).agg(F.sum("n").alias("all"), F.count("*").alias("n_values"), *[F.sum(f"m{i}").alias(f"all{i}") for i in range(len(targets))])
        joined = table.join(totals, F.col("c") == F.col("t_c"))

        def chi2(i):
            def part(observed, of):
                expected = F.col("n") * of / F.col("all")
                off = F.abs(observed - expected)
                off = off - F.when(F.col("n_values") == 2, F.least(F.lit(0.5), off)).otherwise(F.lit(0.0))
                return F.try_divide(off * off, expected)

            with_, all_with = F.col(f"m{i}"), F.col(f"all{i}")
            return F.sum(part(with_, all_with) + part(F.col("n") - with_, F.col("all") - all_with))

        got = joined.groupBy("c").agg(F.first("all").alias("all"), F.first("n_values").alias("n_values"), *[F.first(f"all{i}").alias(f"all{i}") for i in range(len(targets))], *[chi2(i).alias(f"x{i}") for i in range(len(targets))]).collect()
        by = {r["c"]: r for r in got}
        rows = []
        for t, c in pairs:
            r, i = by.get(c), targets.index(t)
            if r is None or r["all"] < self.min_valid or r["n_values"] < 2 or not 0 < r[f"all{i}"] < r["all"]:
                continue
            rows.append((t, c, "categorical", round(math.sqrt(r[f"x{i}"] / r["all"]), 3), round(chi2_upper(r[f"x{i}"], r["n_values"] - 1), 4), "cramers_v"))
        return rows


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()
