"""Queries over the stored tables, one or more for each report, and SQL for their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewell import plotdata
from gaugewell.operators.clusters import MissingnessClusters
from gaugewell.operators.columns import METRICS, ColumnsMissingness
from gaugewell.operators.correlation import MissingnessCorrelation
from gaugewell.operators.density import DensityEstimate
from gaugewell.operators.exact_dups import ExactDuplicates
from gaugewell.operators.near_dups import NearDuplicates
from gaugewell.operators.rows import RowsMissingness
from gaugewell.sources.tables import table
from gaugewell.sources.views import view, view_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PLACES = 6


def _query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _rounded(df, *columns):
    """Sums of doubles differ in their last places with the order of rows."""
    return df.select(*[F.round(c, PLACES).alias(c) if c in columns else F.col(c) for c in df.columns])


def _with(*views):
    return "WITH " + ", ".join(f"{v} AS ({view_sql(v)})" for v in views)


# missingness

ORDER_COLUMNS = {"rid": "bigint", "totalprice": "double", "orderdate": "timestamp", "orderstatus": "string", "orderpriority": "string"}
PAYLOAD = [c for c in ORDER_COLUMNS if c != "rid"]
_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing_count, count(*) AS n, '{t}' AS dtype FROM m_orders" for c, t in ORDER_COLUMNS.items())
_ROW = " + ".join(f"({c} IS NULL)::INT" for c in PAYLOAD)
_ROWS = f"{_with('m_orders')}, r AS (SELECT rid, {_ROW} AS missing_count FROM m_orders)"


def _metric_sql(column, metric):
    made = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})"}
    made |= {f"p{p}": f"quantile_cont({{c}}, 0.{p})" for p in (90, 95, 99)}
    return f"round({made[metric].format(c=column)}, {PLACES})::DOUBLE"


@_query("col_missing_summary", f"{_with('m_orders')} SELECT \"column\", missing_count, missing_count / n AS missing_rate, dtype FROM ({_COUNTS})")
def col_missing_summary(spark, d):
    out = ColumnsMissingness(view(spark, d, "m_orders")).summary().df
    return out.withColumn("dtype", F.regexp_replace("dtype", "_ntz$", ""))


@_query("col_missing_nan", f"{_with('m_nan')} SELECT 'rid' AS \"column\", 0::BIGINT AS missing_count UNION ALL SELECT 'acctbal', count(*) FILTER (acctbal IS NULL OR isnan(acctbal)) FROM m_nan UNION ALL SELECT 'mktsegment', 0")
def col_missing_nan(spark, d):
    return ColumnsMissingness(view(spark, d, "m_nan")).summary().df.select("column", "missing_count")


@_query(
    "col_missing_stats",
    f"{_with('m_orders')}, s AS (SELECT missing_count::DOUBLE AS c, missing_count / n AS r FROM ({_COUNTS})) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {_metric_sql('r', m)} AS rates, {_metric_sql('c', m)} AS counts FROM s" for m in METRICS),
)
def col_missing_stats(spark, d):
    return _rounded(ColumnsMissingness(view(spark, d, "m_orders")).stats().df, "rates", "counts")


def _by_row(spark, d):
    return RowsMissingness(view(spark, d, "m_orders"), "rid")


@_query("row_missing_mask", f"{_with('m_orders')} SELECT rid, {', '.join(f'{c} IS NULL AS {c}' for c in PAYLOAD)} FROM m_orders")
def row_missing_mask(spark, d):
    return _by_row(spark, d).mask()


@_query("row_missing_counts", f"{_ROWS} SELECT rid, missing_count FROM r")
def row_missing_counts(spark, d):
    return _by_row(spark, d).counts()


@_query("row_missing_rates", f"{_ROWS} SELECT rid, missing_count / 4 AS missing_rate FROM r")
def row_missing_rates(spark, d):
    return _by_row(spark, d).rates()


@_query("row_full_missing", f"{_ROWS} SELECT count(*) AS count FROM r WHERE missing_count = 4")
def row_full_missing(spark, d):
    return _by_row(spark, d).full_missing().df


@_query("row_full_missing_ids", f"{_ROWS} SELECT rid FROM r WHERE missing_count = 4 ORDER BY rid LIMIT 20")
def row_full_missing_ids(spark, d):
    return _by_row(spark, d).full_missing(sample_size=20).extra["indices"]


@_query("row_missing_above", f"{_ROWS} SELECT count(*) FILTER (missing_count / 4 >= 0.5) AS count, 0.5::DOUBLE AS threshold, 'above' AS direction, count(*) AS total_rows FROM r")
def row_missing_above(spark, d):
    return _by_row(spark, d).missing_above(0.5).df


@_query("row_missing_below", f"{_ROWS} SELECT count(*) FILTER (missing_count / 4 <= 0.25) AS count, 0.25::DOUBLE AS threshold, 'below' AS direction, count(*) AS total_rows FROM r")
def row_missing_below(spark, d):
    return _by_row(spark, d).missing_below(0.25).df


@_query("row_completeness", f"{_ROWS} SELECT missing_count AS n_missing_fields, count(*) AS n_rows FROM r GROUP BY 1")
def row_completeness(spark, d):
    return _by_row(spark, d).completeness().df


@_query("row_summary", f"{_ROWS} SELECT count(*) AS total_rows, count(*) FILTER (missing_count = 4) AS full_missing_rows, count(*) FILTER (missing_count >= 2) AS missing_rows_above, count(*) FILTER (missing_count <= 1) AS missing_rows_below FROM r")
def row_summary(spark, d):
    return _by_row(spark, d).summary({"above": 0.5, "below": 0.25}).df


@_query("row_stats", f"{_ROWS} SELECT {', '.join(_metric_sql('missing_count / 4', m) + f' AS {m}' for m in METRICS)} FROM r")
def row_stats(spark, d):
    return _rounded(_by_row(spark, d).stats().df, *METRICS)


LINE_VARY = ["quantity", "extendedprice", "discount", "tax", "returnflag"]


@_query(
    "miss_miss_corr",
    f"{_with('m_orders')} " + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(({a} IS NULL)::INT, ({b} IS NULL)::INT), 3) AS corr FROM m_orders" for a in PAYLOAD for b in PAYLOAD),
)
def miss_miss_corr(spark, d):
    return MissingnessCorrelation(view(spark, d, "m_orders"), "rid").missing_missing_corr().df


def _point_sql(v, pairs):
    return " UNION ALL ".join(f"SELECT '{t}' AS missing_column, '{c}' AS compared_to, round(corr(({t} IS NULL)::INT, {c}), 3) AS statistic FROM {v} WHERE {c} IS NOT NULL" for t, c in pairs)


def _cramer(v, t, c):
    return f"""SELECT '{t}' AS missing_column, '{c}' AS compared_to, round(sqrt(sum(pow(abs(o - e) - CASE WHEN n_cells = 4 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) / sum(o)), 3) AS statistic FROM (
  SELECT o, sum(o) OVER (PARTITION BY m) * (sum(o) OVER (PARTITION BY k))::DOUBLE / sum(o) OVER () AS e, count(*) OVER () AS n_cells FROM (
    SELECT m, k, CASE m WHEN 1 THEN one ELSE n - one END AS o FROM (SELECT {c} AS k, count(*) AS n, count(*) FILTER ({t} IS NULL) AS one FROM {v} WHERE {c} IS NOT NULL GROUP BY 1), (SELECT unnest([0, 1]) AS m)))"""


@_query("miss_observed_numeric", f"{_with('m_orders')} {_point_sql('m_orders', [(t, 'totalprice') for t in ('orderdate', 'orderstatus', 'orderpriority')])}")
def miss_observed_numeric(spark, d):
    out = MissingnessCorrelation(view(spark, d, "m_orders"), "rid").missing_observed_corr().df
    return out.where("compared_type = 'numeric'").select("missing_column", "compared_to", "statistic")


@_query("miss_observed_categorical", f"{_with('m_lineitem')} " + " UNION ALL ".join(_cramer("m_lineitem", t, c) for c in ("returnflag", "linestatus") for t in LINE_VARY if t != c))
def miss_observed_categorical(spark, d):
    out = MissingnessCorrelation(view(spark, d, "m_lineitem")).missing_observed_corr().df
    return out.where("compared_type = 'categorical'").select("missing_column", "compared_to", "statistic")


@_query("miss_target_corr", f"{_with('m_documents')} SELECT * FROM ({_point_sql('m_documents', [('quality', 'rid'), ('quality', 'n_chars')])}) UNION ALL SELECT * FROM ({_cramer('m_documents', 'quality', 'lang')}) UNION ALL SELECT * FROM ({_cramer('m_documents', 'quality', 'source')})")
def miss_target_corr(spark, d):
    return MissingnessCorrelation(view(spark, d, "m_documents")).missing_target_corr("quality").df.where("compared_to <> 'toxic'").select("missing_column", "compared_to", "statistic")


_LINE_NUMBERS, _LINE_WORDS = ["quantity", "extendedprice", "discount", "tax"], ["returnflag", "linestatus"]
_T_TESTS = " UNION ALL ".join(f"SELECT '{t}' AS missing_column, '{c}' AS compared_to, corr(({t} IS NULL)::INT, {c}) AS r, count({c})::DOUBLE AS n FROM m_lineitem WHERE {c} IS NOT NULL" for t in LINE_VARY for c in _LINE_NUMBERS if t != c)
_CHI_TESTS = " UNION ALL ".join(
    f"""SELECT '{t}' AS missing_column, '{c}' AS compared_to, sum(pow(abs(o - e) - CASE WHEN n_cells = 4 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS x, sum(o)::DOUBLE AS n, any_value(n_cells) / 2 - 1 AS dof FROM (
  SELECT o, sum(o) OVER (PARTITION BY m) * (sum(o) OVER (PARTITION BY k))::DOUBLE / sum(o) OVER () AS e, count(*) OVER () AS n_cells FROM (
    SELECT m, k, CASE m WHEN 1 THEN one ELSE n - one END AS o FROM (SELECT {c} AS k, count(*) AS n, count(*) FILTER ({t} IS NULL) AS one FROM m_lineitem WHERE {c} IS NOT NULL GROUP BY 1), (SELECT unnest([0, 1]) AS m)))"""
    for t in LINE_VARY
    for c in _LINE_WORDS
    if t != c
)
#: Student's t by Simpson's rule, chi-squared by the series of the incomplete gamma function.
_TESTS = f"""{_with('m_lineitem')}, tt AS (SELECT *, least(abs(r) * sqrt((n - 2) / (1 - r * r)), 50) AS t FROM ({_T_TESTS}) WHERE NOT isnan(r)),
tp AS (SELECT missing_column, compared_to, 'numeric' AS compared_type, round(any_value(r), 3) AS statistic, 'point_biserial' AS method,
    1 - 2 * sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2) - 0.5 * ln((n - 2) * pi()) - (n - 1) / 2 * ln(1 + pow(t * i / 2000, 2) / (n - 2))) * t / 6000) AS p
    FROM tt, (SELECT unnest(range(2001)) AS i) GROUP BY ALL),
cp AS (SELECT missing_column, compared_to, 'categorical' AS compared_type, round(sqrt(any_value(x / n)), 3) AS statistic, 'cramers_v' AS method,
    CASE WHEN any_value(x) > 600 THEN 0 ELSE 1 - sum(CASE WHEN x > 0 THEN exp((dof / 2 + i) * ln(x / 2) - x / 2 - lgamma(dof / 2 + i + 1)) ELSE 0 END) END AS p
    FROM ({_CHI_TESTS}), (SELECT unnest(range(1500)) AS i) GROUP BY ALL),
tests AS (SELECT missing_column, compared_to, compared_type, statistic, round(greatest(p, 0), 4) AS p_value, method FROM (SELECT * FROM tp UNION ALL SELECT * FROM cp))"""


@_query("miss_observed_tests", f"{_TESTS} SELECT * FROM tests")
def miss_observed_tests(spark, d):
    return MissingnessCorrelation(view(spark, d, "m_lineitem")).missing_observed_corr().df


@_query("miss_observed_chart", f"{_TESTS} SELECT *, p_value < 0.05 AS significant, round(abs(statistic) / max(abs(statistic)) OVER (), {PLACES}) AS size FROM tests")
def miss_observed_chart(spark, d):
    return _rounded(MissingnessCorrelation(view(spark, d, "m_lineitem")).missing_observed_corr().plot, "size")


@_query("miss_mask", f"{_with('m_orders')} SELECT {', '.join(f'{c} IS NULL AS {c}' for c in PAYLOAD)} FROM m_orders")
def miss_mask(spark, d):
    return MissingnessCorrelation(view(spark, d, "m_orders"), "rid").mask()


@_query("miss_miss_chart", ORACLES["miss_miss_corr"])
def miss_miss_chart(spark, d):
    return MissingnessCorrelation(view(spark, d, "m_orders"), "rid").missing_missing_corr().plot


@_query("col_missing_chart", ORACLES["col_missing_summary"])
def col_missing_chart(spark, d):
    return ColumnsMissingness(view(spark, d, "m_orders")).summary().plot.withColumn("dtype", F.regexp_replace("dtype", "_ntz$", ""))


@_query("col_stats_chart", ORACLES["col_missing_stats"])
def col_stats_chart(spark, d):
    return _rounded(ColumnsMissingness(view(spark, d, "m_orders")).stats().plot, "rates", "counts")


@_query("row_full_chart", ORACLES["row_full_missing"])
def row_full_chart(spark, d):
    return _by_row(spark, d).full_missing().plot


@_query("row_above_chart", f"{_ROWS} SELECT 'matching' AS part, count(*) FILTER (missing_count >= 2) AS rows FROM r UNION ALL SELECT 'others', count(*) FILTER (missing_count < 2) FROM r")
def row_above_chart(spark, d):
    return _by_row(spark, d).missing_above(0.5).plot


@_query("row_below_chart", f"{_ROWS} SELECT 'matching' AS part, count(*) FILTER (missing_count <= 1) AS rows FROM r UNION ALL SELECT 'others', count(*) FILTER (missing_count > 1) FROM r")
def row_below_chart(spark, d):
    return _by_row(spark, d).missing_below(0.25).plot


@_query("row_completeness_chart", ORACLES["row_completeness"])
def row_completeness_chart(spark, d):
    return _by_row(spark, d).completeness().plot


@_query("row_summary_chart", f"{_ROWS} UNPIVOT (SELECT count(*) AS total_rows, count(*) FILTER (missing_count = 4) AS full_missing_rows, count(*) FILTER (missing_count >= 2) AS missing_rows_above FROM r) ON COLUMNS(*) INTO NAME measure VALUE rows")
def row_summary_chart(spark, d):
    return _by_row(spark, d).summary({"above": 0.5}).plot


@_query("row_stats_chart", f"{_ROWS} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {_metric_sql('missing_count / 4', m)} AS rate FROM r" for m in METRICS))
def row_stats_chart(spark, d):
    return _rounded(_by_row(spark, d).stats().plot, "rate")


_NAMED = {
    "dataset.missingness.rates.columns": "missingness.column_rates",
    "dataset.missingness.rates.rows": "missingness.row_rates",
    "dataset.missingness.clusters": "missingness.row_clusters",
    "dataset.duplicates.exact": "duplicates.exact",
    "dataset.duplicates.near": "duplicates.near",
    "coverage.density": "coverage.density",
}


@_query("capabilities", " UNION ALL ".join(f"SELECT '{i}' AS id, '{c}' AS capability_name" for i, c in _NAMED.items()))
def capabilities(spark, d):
    every = [ColumnsMissingness, RowsMissingness, MissingnessClusters, ExactDuplicates, NearDuplicates, DensityEstimate]
    return spark.createDataFrame([(a.id, a.capability_name.fget(a)) for a in every], "id string, capability_name string")


_SIG = f"""{_with('m_orders')}, r AS (SELECT rid, {' || '.join(f"({c} IS NULL)::INT" for c in PAYLOAD)} AS s FROM m_orders),
c AS (SELECT s, count(*) AS n FROM r GROUP BY 1), k AS (SELECT s, n, row_number() OVER (ORDER BY n DESC, s) - 1 AS cluster_id, sum(n) OVER () AS total FROM c)"""
_MISSING_LIST = "concat_ws(',', " + ", ".join(f"CASE WHEN s[{i + 1}] = '1' THEN '{c}' END" for i, c in enumerate(PAYLOAD)) + ")"


@_query("cluster_exact_table", f"{_SIG} SELECT cluster_id::INT AS cluster_id, n AS size, n / total AS rate, (length(s) - length(replace(s, '1', '')))::INT AS n_missing_cols, {_MISSING_LIST} AS missing_columns FROM k")
def cluster_exact_table(spark, d):
    return MissingnessClusters(view(spark, d, "m_orders"), "rid").clusters().table.withColumn("missing_columns", F.array_join("missing_columns", ","))


@_query("cluster_labels", f"{_SIG} SELECT rid, cluster_id::INT AS cluster_id FROM r JOIN k USING (s)")
def cluster_labels(spark, d):
    return MissingnessClusters(view(spark, d, "m_orders"), "rid").clusters().labels


@_query("cluster_pattern", f"{_SIG} " + " UNION ALL ".join(f"SELECT cluster_id::INT AS cluster_id, '{c}' AS \"column\", s[{i + 1}]::DOUBLE AS fraction FROM k" for i, c in enumerate(PAYLOAD)))
def cluster_pattern(spark, d):
    return MissingnessClusters(view(spark, d, "m_orders"), "rid").pattern_matrix()


@_query("cluster_rows_in", f"{_SIG} SELECT rid FROM r JOIN k USING (s) WHERE cluster_id = 1")
def cluster_rows_in(spark, d):
    return MissingnessClusters(view(spark, d, "m_orders"), "rid").rows_in(1).select("rid")


@_query("cluster_summary", f"{_SIG} SELECT count(*) AS n_clusters, max(n / total) AS largest_cluster_rate, coalesce(sum(CASE WHEN s = '0000' THEN n END), 0) / max(total) AS complete_rows_rate FROM k")
def cluster_summary(spark, d):
    return MissingnessClusters(view(spark, d, "m_orders"), "rid").summary()


_TEXT = """CASE WHEN s = '0000' THEN 'complete rows' ELSE array_to_string(l[:3], ', ') || CASE WHEN len(l) > 3 THEN ' +' || (len(l) - 3) ELSE '' END END"""


@_query("cluster_chart", f"{_SIG} SELECT cluster_id::INT AS cluster_id, n AS size, n / total AS rate, {_TEXT} AS description FROM (SELECT *, string_split({_MISSING_LIST}, ',') AS l FROM k) ORDER BY cluster_id LIMIT 15")
def cluster_chart(spark, d):
    return MissingnessClusters(view(spark, d, "m_orders"), "rid").chart()


@_query("cluster_pattern_chart", f"{_SIG} " + " UNION ALL ".join(f"SELECT cluster_id::INT AS cluster_id, '{c}' AS \"column\", s[{i + 1}]::DOUBLE AS fraction FROM k WHERE cluster_id < 5" for i, c in enumerate(PAYLOAD)))
def cluster_pattern_chart(spark, d):
    return plotdata.pattern(MissingnessClusters(view(spark, d, "m_orders"), "rid"), top_n=5)


def _merges_sql():
    """Average linkage of m_lineitem's signatures, a merge at a time: slots (d: distances, s: names and sizes, o: where each signature is) after k merges, and the merges m."""
    vary = LINE_VARY
    most = 2 ** len(vary) - 1
    sig = " || ".join(f"({c} IS NULL)::INT" for c in vary)
    apart = " + ".join(f"(x.g[{i + 1}] <> y.g[{i + 1}])::INT" for i in range(len(vary)))
    parts = [
        f"g AS MATERIALIZED (SELECT {sig} AS g, count(*) AS rows FROM m_lineitem GROUP BY 1)",
        "n AS MATERIALIZED (SELECT g, rows, row_number() OVER (ORDER BY g) - 1 AS slot, count(*) OVER () AS n FROM g)",
        f"d0 AS MATERIALIZED (SELECT x.slot AS a, y.slot AS b, ({apart}) / {len(vary)}::DOUBLE AS d FROM n x JOIN n y ON x.slot <> y.slot)",
        "s0 AS MATERIALIZED (SELECT slot, slot AS name, 1::DOUBLE AS size FROM n)",
        "o0 AS MATERIALIZED (SELECT g, slot AS spot FROM n)",
    ]
    for k in range(most):
        parts += [
            f"m{k} AS MATERIALIZED (SELECT a, b, d, x.name AS p, y.name AS q, x.size AS u, y.size AS v FROM d{k} JOIN s{k} x ON x.slot = a JOIN s{k} y ON y.slot = b ORDER BY d, a, b LIMIT 1)",
            f"""d{k + 1} AS MATERIALIZED (SELECT t.a, t.b, CASE WHEN t.a = m.a OR t.b = m.a THEN (m.u * t.d + m.v * r.d) / (m.u + m.v) ELSE t.d END AS d
  FROM d{k} t CROSS JOIN m{k} m LEFT JOIN d{k} r ON r.a = m.b AND r.b = CASE WHEN t.a = m.a THEN t.b ELSE t.a END WHERE t.a <> m.b AND t.b <> m.b)""",
            f"s{k + 1} AS MATERIALIZED (SELECT slot, CASE WHEN slot = m.a THEN (SELECT any_value(n) FROM n) + {k} ELSE name END AS name, CASE WHEN slot = m.a THEN m.u + m.v ELSE size END AS size FROM s{k} CROSS JOIN m{k} m WHERE slot <> m.b)",
            f"o{k + 1} AS MATERIALIZED (SELECT g, CASE WHEN spot = m.b THEN m.a ELSE spot END AS spot FROM o{k} CROSS JOIN m{k} m)",
        ]
    parts.append("merges AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM m{k}" for k in range(most)) + ")")
    return f"{_with('m_lineitem')}, " + ", ".join(parts), most


_MERGES, _MOST = _merges_sql()
_MISSES = "concat_ws(',', " + ", ".join(f"CASE WHEN sum(rows) FILTER (g[{i + 1}] = '1') / sum(rows) > 0.5 THEN '{c}' END" for i, c in enumerate(LINE_VARY)) + ")"


@_query(
    "cluster_hierarchical",
    f"""{_MERGES}, stop AS (SELECT coalesce(min(k) FILTER (n - k <= 6 AND d > before), max(k) + 1) AS k FROM (SELECT k, d, lag(d) OVER (ORDER BY k) AS before, (SELECT any_value(n) FROM n) AS n FROM merges)),
o AS ({" UNION ALL ".join(f"SELECT {k} AS k, * FROM o{k}" for k in range(_MOST + 1))}),
c AS (SELECT spot, sum(rows)::BIGINT AS size, sum(rows) / (SELECT sum(rows) FROM n) AS rate, {_MISSES} AS missing_columns FROM o JOIN n USING (g) WHERE k = (SELECT k FROM stop) GROUP BY spot)
SELECT (row_number() OVER (ORDER BY size DESC, spot) - 1)::INT AS cluster_id, size, rate, CASE WHEN missing_columns = '' THEN 0 ELSE len(string_split(missing_columns, ',')) END::INT AS n_missing_cols, missing_columns FROM c""",
)
def cluster_hierarchical(spark, d):
    return MissingnessClusters(view(spark, d, "m_lineitem")).clusters("hierarchical", k=6).table.withColumn("missing_columns", F.array_join("missing_columns", ","))


@_query("cluster_dendrogram", f"{_MERGES} SELECT least(p, q)::INT AS a, greatest(p, q)::INT AS b, round(d, {PLACES}) AS height, (u + v)::INT AS size FROM merges")
def cluster_dendrogram(spark, d):
    return _rounded(plotdata.dendrogram(MissingnessClusters(view(spark, d, "m_lineitem"))), "height")


# exact duplicates

LINE_KEYS, DOC_KEYS = ["l_quantity", "l_discount", "l_tax", "l_returnflag"], ["text"]


def _groups_sql(v, keys, by="count(DISTINCT split) AS n_splits, count(DISTINCT label) AS n_labels"):
    order = ", ".join(f"{k} NULLS LAST" for k in keys)
    return f"{_with(v)}, g AS (SELECT {', '.join(keys)}, count(*) AS size, {by}, dense_rank() OVER (ORDER BY {order}) - 1 AS group_id FROM {v} GROUP BY {', '.join(keys)})"


_RATE = "coalesce(sum(size), 0)::BIGINT AS n_rows, coalesce(sum(size) FILTER (size > 1), 0)::BIGINT AS n_duplicate_rows, coalesce(sum(size) FILTER (size > 1), 0) / sum(size) AS rate, count(*) FILTER (size > 1) AS n_groups"
_SUMMARY = f"SELECT {_RATE}, count(*) FILTER (size > 1 AND n_splits > 1) AS cross_split_groups, count(*) FILTER (size > 1 AND n_splits > 1) / count(*) FILTER (size > 1) AS cross_split_rate_of_groups, count(*) FILTER (size > 1 AND n_labels > 1) AS conflicting_groups, count(*) FILTER (size > 1 AND n_labels > 1) / count(*) FILTER (size > 1) AS conflict_rate_of_groups FROM g"
_DOC_GROUPS = _groups_sql("dup_documents", DOC_KEYS, "list_sort(list(DISTINCT split)) AS splits, list_sort(list(DISTINCT label)) AS labels")


def _lines(spark, d):
    return ExactDuplicates(view(spark, d, "dup_lineitem"), "split", "label")


def _docs(spark, d):
    return ExactDuplicates(view(spark, d, "dup_documents"), "split", "label", "doc_id")


@_query("dup_rate", f"{_groups_sql('dup_lineitem', LINE_KEYS)} SELECT {_RATE} FROM g")
def dup_rate(spark, d):
    return _lines(spark, d).duplicate_rate()


@_query("dup_summary", f"{_groups_sql('dup_lineitem', LINE_KEYS)} {_SUMMARY}")
def dup_summary(spark, d):
    return _lines(spark, d).summary()


@_query("dup_groups_lineitem", f"{_groups_sql('dup_lineitem', LINE_KEYS)} SELECT group_id, size, size - 1 AS removable_rows FROM g WHERE size > 1")
def dup_groups_lineitem(spark, d):
    return _lines(spark, d).duplicate_groups()


@_query("dup_groups", f"{_DOC_GROUPS} SELECT group_id, size, size - 1 AS removable_rows FROM g WHERE size > 1")
def dup_groups(spark, d):
    return _docs(spark, d).duplicate_groups()


@_query("dup_group_members", f"{_DOC_GROUPS} SELECT group_id, doc_id FROM g JOIN dup_documents USING (text) WHERE size > 1")
def dup_group_members(spark, d):
    return _docs(spark, d).group_members()


@_query("dup_rows_in", f"{_DOC_GROUPS} SELECT doc_id, split, label FROM g JOIN dup_documents USING (text) WHERE group_id = 0")
def dup_rows_in(spark, d):
    return _docs(spark, d).rows_in(0).select("doc_id", "split", "label")


@_query("dup_cross_split", f"{_DOC_GROUPS} SELECT group_id, size, array_to_string(splits, ',') AS splits, len(splits)::INT AS n_splits, len(splits) > 1 AS is_cross_split FROM g WHERE size > 1")
def dup_cross_split(spark, d):
    return _docs(spark, d).cross_split_overlap().withColumn("splits", F.array_join("splits", ","))


@_query("dup_label_conflicts", f"{_DOC_GROUPS} SELECT group_id, size, array_to_string(labels, ',') AS labels, len(labels)::INT AS n_distinct_labels, len(labels) > 1 AS has_conflict FROM g WHERE size > 1")
def dup_label_conflicts(spark, d):
    return _docs(spark, d).label_conflicts().withColumn("labels", F.array_join("labels", ","))


@_query(
    "dup_from_splits",
    f"{_with('train_customers', 'test_customers')}, g AS (SELECT c_nationkey, c_mktsegment, count(*) AS size, count(DISTINCT split) AS n_splits FROM (SELECT c_nationkey, c_mktsegment, 'train' AS split FROM train_customers UNION ALL SELECT c_nationkey, c_mktsegment, 'test' FROM test_customers) GROUP BY 1, 2) SELECT {_RATE}, count(*) FILTER (size > 1 AND n_splits > 1) AS cross_split_groups, count(*) FILTER (size > 1 AND n_splits > 1) / count(*) FILTER (size > 1) AS cross_split_rate_of_groups FROM g",
)
def dup_from_splits(spark, d):
    return ExactDuplicates.from_splits({"train": view(spark, d, "train_customers"), "test": view(spark, d, "test_customers")}).summary()


@_query("dup_group_size_chart", f"{_groups_sql('dup_lineitem', LINE_KEYS)} SELECT group_id, size, size - 1 AS removable_rows FROM g WHERE size > 1 ORDER BY size DESC, group_id LIMIT 20")
def dup_group_size_chart(spark, d):
    return plotdata.group_sizes(_lines(spark, d))


@_query("dup_split_chart", f"{_groups_sql('dup_lineitem', LINE_KEYS)} SELECT 'cross_split' AS part, count(*) FILTER (n_splits > 1) AS rows FROM g WHERE size > 1 UNION ALL SELECT 'within_split', count(*) FILTER (n_splits < 2) FROM g WHERE size > 1")
def dup_split_chart(spark, d):
    return plotdata.groups_by_split(_lines(spark, d))


@_query("dup_conflict_chart", f"{_groups_sql('dup_lineitem', LINE_KEYS)} SELECT 'conflicting' AS part, count(*) FILTER (n_labels > 1) AS rows FROM g WHERE size > 1 UNION ALL SELECT 'consistent', count(*) FILTER (n_labels < 2) FROM g WHERE size > 1")
def dup_conflict_chart(spark, d):
    return plotdata.groups_by_conflict(_lines(spark, d))


@_query("dup_overview_chart", f"{_groups_sql('dup_lineitem', LINE_KEYS)} SELECT 'duplicate' AS part, coalesce(sum(size) FILTER (size > 1), 0)::BIGINT AS rows FROM g UNION ALL SELECT 'unique', count(*) FILTER (size = 1) FROM g")
def dup_overview_chart(spark, d):
    return plotdata.duplicate_overview(_lines(spark, d))


# near duplicates


def _pairs_sql(v, id_, numeric, categorical, threshold, block=(), extra=""):
    """All pairs, scored by the definition."""
    p, c = len(numeric), len(categorical)
    over = f"OVER (PARTITION BY {', '.join(block)})" if block else "OVER ()"
    scaled = ", ".join(f"({n} - min({n}) {over})::DOUBLE / coalesce(nullif(max({n}) {over} - min({n}) {over}, 0), 1) AS x{i}" for i, n in enumerate(numeric))
    apart = " + ".join(f"pow(a.x{i} - b.x{i}, 2)" for i in range(p))
    same = " + ".join(f"(a.{k} IS NOT DISTINCT FROM b.{k})::INT" for k in categorical) or "0"
    score = f"{p / (p + c)!r}::DOUBLE * (1 - sqrt({apart}) / sqrt({p}))" + (f" + {c / (p + c)!r}::DOUBLE * (({same})::DOUBLE / ({2 * c} - ({same})))" if c else "")
    names = "concat_ws(',', " + ", ".join(f"CASE WHEN a.{k} IS DISTINCT FROM b.{k} THEN '{k}' END" for k in [*numeric, *categorical]) + ")"
    on = " AND ".join([f"a.{id_} < b.{id_}", *[f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in block]])
    return f"""{_with(v)}, s AS (SELECT *, {scaled} FROM {v}),
p AS (SELECT a.{id_} AS row_i, b.{id_} AS row_j, {score} AS score, {names} AS differing{extra} FROM s a JOIN s b ON {on}),
q AS (SELECT *, round(score, 4) AS similarity, CASE WHEN differing = '' THEN 0 ELSE len(string_split(differing, ',')) END AS n_differing FROM p WHERE score >= {threshold})"""


_PART = ("near_part", "p_partkey", ["p_size", "p_retailprice"], ["p_brand", "p_type"])
_PAIRS = "SELECT row_i, row_j, similarity, differing AS differing_columns, n_differing::INT AS n_differing FROM q"
_SPLITS = ", a.split AS split_i, b.split AS split_j"
_SCOPE = "count(*) FILTER (split_i = split_j) AS {w}, count(*) FILTER (split_i <> split_j) AS {x}, coalesce(count(*) FILTER (split_i <> split_j) / nullif(count(*), 0), 0) AS cross_split_rate"


def _parts(spark, d, threshold=0.97, **how):
    return NearDuplicates(view(spark, d, "near_part"), "p_partkey", _PART[2], _PART[3], split_col="split", threshold=threshold, **how)


def _listed(pairs):
    return pairs.withColumn("differing_columns", F.array_join("differing_columns", ","))


@_query("near_pairs_exact", f"{_pairs_sql(*_PART, 0.97)} {_PAIRS}")
def near_pairs_exact(spark, d):
    return _listed(_parts(spark, d).find_pairs())


@_query("near_pairs_loose", f"{_pairs_sql('near_supplier', 's_suppkey', ['s_acctbal'], ['nation', 'label'], 0.85)} {_PAIRS}")
def near_pairs_loose(spark, d):
    return _listed(NearDuplicates(view(spark, d, "near_supplier"), "s_suppkey", ["s_acctbal"], ["nation", "label"], threshold=0.85).find_pairs())


@_query("near_pairs_customer", f"{_pairs_sql('near_customer', 'c_custkey', ['c_acctbal'], ['nation', 'c_mktsegment'], 0.999)} {_PAIRS}")
def near_pairs_customer(spark, d):
    return _listed(NearDuplicates(view(spark, d, "near_customer"), "c_custkey", ["c_acctbal"], ["nation", "c_mktsegment"], threshold=0.999).find_pairs())


@_query("near_pairs_lsh", f"{_pairs_sql(*_PART, 0.97, block=('p_brand',))} {_PAIRS}")
def near_pairs_lsh(spark, d):
    return _listed(_parts(spark, d, method="lsh", block_cols=["p_brand"]).find_pairs())


@_query("near_scope", f"{_pairs_sql(*_PART, 0.97, extra=_SPLITS)} SELECT {_SCOPE.format(w='within_split', x='cross_split')} FROM q")
def near_scope(spark, d):
    return _parts(spark, d).pairs_by_scope()


@_query("near_summary", f"{_pairs_sql(*_PART, 0.97, extra=_SPLITS)} SELECT count(*) AS n_pairs, 0.97::DOUBLE AS threshold, 'exact' AS method, round(avg(similarity), {PLACES}) AS mean_similarity, min(similarity) AS min_similarity, {_SCOPE.format(w='within_split_pairs', x='cross_split_pairs')} FROM q")
def near_summary(spark, d):
    return _rounded(_parts(spark, d).summary(), "mean_similarity")


@_query(
    "near_differing",
    f"{_pairs_sql('near_supplier', 's_suppkey', ['s_acctbal'], ['nation'], 0.97, extra=', a.label AS label_i, b.label AS label_j')} "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (list_contains(string_split(differing, ','), '{c}')) AS times_differing, count(*) FILTER (differing = '{c}') AS times_sole_diff FROM q" for c in ("s_acctbal", "nation"))
    + " UNION ALL SELECT 'label (label, not in similarity calc)', count(*) FILTER (differing = '' AND label_i <> label_j), count(*) FILTER (differing = '' AND label_i <> label_j) FROM q",
)
def near_differing(spark, d):
    return NearDuplicates(view(spark, d, "near_supplier"), "s_suppkey", ["s_acctbal"], ["nation"], label_col="label").differing_columns_summary()


@_query(
    "near_vs_exact",
    f"{_pairs_sql(*_PART, 0.97)}, e AS (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS n FROM (SELECT count(*) AS n FROM near_part GROUP BY p_size, p_brand)) SELECT (SELECT count(*) FROM q) AS n_near_pairs, n AS n_exact_pairs, CASE WHEN n > 0 THEN (SELECT count(*) FROM q) / n WHEN (SELECT count(*) FROM q) > 0 THEN 'infinity'::DOUBLE ELSE 0 END AS ratio FROM e",
)
def near_vs_exact(spark, d):
    return _parts(spark, d).near_vs_exact_ratio(ExactDuplicates(view(spark, d, "near_part").select("p_size", "p_brand")))


_PERMUTED = ", ".join(f"y{i} AS (SELECT {c}, row_number() OVER (ORDER BY md5('0|{i}|' || p_partkey), p_partkey) AS row FROM {{v}} QUALIFY row <= 2000)" for i, c in enumerate([*_PART[2], *_PART[3]]))
_PERMUTED = _PERMUTED.format(v="near_part") + f", permuted AS (SELECT y0.row AS p_partkey, {', '.join([*_PART[2], *_PART[3]])} FROM y0 JOIN y1 USING (row) JOIN y2 USING (row) JOIN y3 USING (row))"


@_query(
    "near_false_positive",
    _pairs_sql("near_part", "p_partkey", _PART[2], _PART[3], 0.97).replace("\ns AS", "\nunused AS", 0).replace("s AS (SELECT *,", f"{_PERMUTED}, s AS (SELECT *,", 1).replace("FROM near_part),\np AS", "FROM permuted),\np AS", 1)
    + " SELECT 0.97::DOUBLE AS threshold, n * (n - 1) // 2 AS n_pairs_checked, (SELECT count(*) FROM q) / (n * (n - 1) // 2) AS false_positive_rate FROM (SELECT count(*) AS n FROM permuted)",
)
def near_false_positive(spark, d):
    return _parts(spark, d).false_positive_rate()


@_query("near_cross_split_pairs", f"{_pairs_sql(*_PART, 0.97, extra=_SPLITS)} SELECT row_i, row_j, similarity, split_i, split_j FROM q WHERE split_i <> split_j")
def near_cross_split_pairs(spark, d):
    return _parts(spark, d).cross_split_pairs()


# density

_KDE = """WITH st AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, count(*) AS n, pow(count(*), -0.2) AS h, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
z AS (SELECT c_custkey AS id, (c_acctbal - m) / s AS z, c_acctbal AS x FROM customer, st),
e AS (SELECT a.id, -0.5 * pow((a.z - b.z) / h, 2) AS e FROM {points} a CROSS JOIN z b, st),
mx AS (SELECT id, max(e) AS mx FROM e GROUP BY id),
d AS (SELECT id, any_value(mx) + ln(sum(exp(e - mx))) - ln(any_value(n)) - ln(any_value(h)) - 0.5 * ln(2 * pi()) AS log_density FROM e JOIN mx USING (id), st GROUP BY id)"""
_ROW_KDE = _KDE.format(points="z")
_LINE_KDE = _KDE.replace("e AS (", "line AS (SELECT i AS id, lo - 0.05 * (hi - lo) + i * 1.1 * (hi - lo) / 299 AS x, (lo - 0.05 * (hi - lo) + i * 1.1 * (hi - lo) / 299 - m) / s AS z FROM (SELECT unnest(range(300)) AS i), st),\ne AS (", 1).format(points="line")


def _accounts(spark, d):
    return DensityEstimate(table(spark, d, "customer"), "c_custkey", ["c_acctbal"])


def _part_density(spark, d, **how):
    return DensityEstimate(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"], **how)


@_query("kde_row_density", f"{_ROW_KDE} SELECT id AS c_custkey, round(log_density, {PLACES}) AS log_density FROM d")
def kde_row_density(spark, d):
    return _rounded(_accounts(spark, d).row_density(), "log_density")


@_query("kde_score", f"{_KDE.replace('e AS (', 'pt AS (SELECT s_suppkey AS id, (s_acctbal - m) / s AS z FROM supplier, st),' + chr(10) + 'e AS (', 1).format(points='pt')} SELECT id AS s_suppkey, round(log_density, {PLACES}) AS log_density FROM d")
def kde_score(spark, d):
    points = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("c_acctbal"))
    return _rounded(_accounts(spark, d).score(points).select("s_suppkey", "log_density"), "log_density")


@_query(
    "kde_summary",
    f"{_ROW_KDE}, q AS (SELECT quantile_cont(log_density, 0.1) AS q FROM d) SELECT 'kde' AS method, count(*) AS n_rows, 1 AS n_dims, round(min(log_density), 6) AS log_density_min, round(max(log_density), 6) AS log_density_max, round(avg(log_density), 6) AS log_density_mean, round(quantile_cont(log_density, 0.5), 6) AS log_density_median, round(any_value(q), 6) AS low_density_threshold, count(*) FILTER (log_density < q) / count(*) AS pct_rows_low_density FROM d, q",
)
def kde_summary(spark, d):
    return _rounded(_accounts(spark, d).density_summary(), "log_density_min", "log_density_max", "log_density_mean", "log_density_median", "low_density_threshold")


@_query("kde_density_1d", f"{_LINE_KDE} SELECT id::INT AS i, round(x, 4) AS x, round(exp(log_density), {PLACES}) AS density FROM d JOIN line USING (id)")
def kde_density_1d(spark, d):
    return _accounts(spark, d).density_1d("c_acctbal").select("i", F.round("x", 4).alias("x"), F.round("density", PLACES).alias("density"))


_GRID = """WITH st AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2, count(*) AS n, pow(count(*), -1.0 / 6) AS h,
  min(p_size) AS a1, max(p_size) AS b1, min(p_retailprice) AS a2, max(p_retailprice) AS b2 FROM part),
z AS (SELECT (p_size - m1) / s1 AS u, (p_retailprice - m2) / s2 AS v FROM part, st),
g AS (SELECT i, j, a1 - 0.05 * (b1 - a1) + i * 1.1 * (b1 - a1) / 99 AS x, a2 - 0.05 * (b2 - a2) + j * 1.1 * (b2 - a2) / 99 AS y FROM (SELECT unnest(range(100)) AS i), (SELECT unnest(range(100)) AS j), st),
e AS (SELECT i, j, any_value(x) AS x, any_value(y) AS y, ln(sum(exp(-0.5 * (pow(((x - m1) / s1 - u) / h, 2) + pow(((y - m2) / s2 - v) / h, 2))))) - ln(any_value(n)) - 2 * ln(any_value(h)) - ln(2 * pi()) AS log_density FROM g, z, st GROUP BY i, j)
SELECT i::INT AS i, j::INT AS j, round(x, 4) AS x, round(y, 4) AS y, round(log_density, 6) AS log_density FROM e"""


@_query("kde_grid", _GRID)
def kde_grid(spark, d):
    return _grid(_part_density(spark, d).density_grid(("p_size", "p_retailprice")))


def _grid(out, places=PLACES):
    return out.select("i", "j", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("log_density", places).alias("log_density"))


_POINTS = "SELECT p_size, p_retailprice FROM part ORDER BY md5('0|' || p_partkey), p_partkey LIMIT 2000"


@_query("density_2d_grid", _GRID)
def density_2d_grid(spark, d):
    return _grid(plotdata.density_2d(_part_density(spark, d), ("p_size", "p_retailprice"))["grid"])


@_query("density_2d_points", _POINTS)
def density_2d_points(spark, d):
    return plotdata.density_2d(_part_density(spark, d), ("p_size", "p_retailprice"))["points"]


@_query("low_density_share", f"{_ROW_KDE}, q AS (SELECT count(*) FILTER (log_density < (SELECT quantile_cont(log_density, 0.1) FROM d)) AS low, count(*) AS n FROM d) SELECT 'low_density' AS part, low AS rows FROM q UNION ALL SELECT 'others', n - low FROM q")
def low_density_share(spark, d):
    return plotdata.low_density_share(_accounts(spark, d))


def _region_sql(side):
    """One dimension: the chosen rows in order; gaps over eps part the clusters. Cores, components and borders by the definition."""
    chosen = {"low": "log_density < (SELECT quantile_cont(log_density, 0.1) FROM d)", "high": "log_density > (SELECT quantile_cont(log_density, 0.9) FROM d)"}[side]
    return f"""{_ROW_KDE}, c AS (SELECT id, z, log_density FROM d JOIN z USING (id) WHERE {chosen}),
nb AS (SELECT a.id, b.id AS o, a.z FROM c a JOIN c b ON abs(a.z - b.z) <= 0.5),
core AS (SELECT id, any_value(z) AS z FROM nb GROUP BY id HAVING count(*) >= 5),
run AS (SELECT id, z, sum(CASE WHEN z - before <= 0.5 THEN 0 ELSE 1 END) OVER (ORDER BY z, id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT id, z, lag(z) OVER (ORDER BY z, id) AS before FROM core)),
lab AS (SELECT run, dense_rank() OVER (ORDER BY least_id) - 1 AS region FROM (SELECT run, min(id) AS least_id FROM run GROUP BY run)),
cl AS (SELECT id, region FROM run JOIN lab USING (run)),
al AS (SELECT id, region FROM cl UNION ALL SELECT nb.id, min(region) FROM nb JOIN cl ON nb.o = cl.id WHERE nb.id NOT IN (SELECT id FROM cl) GROUP BY nb.id),
ce AS (SELECT region, count(*) AS n_points, avg(log_density) AS l, avg(z) AS mz FROM al JOIN c USING (id) GROUP BY region)
SELECT region::BIGINT AS region_id, any_value(n_points) AS n_points, round(any_value(l), 6) AS mean_log_density, round(any_value(m + s * mz), 4) AS centroid, round(max(abs(z - mz)), 6) AS radius
FROM al JOIN c USING (id) JOIN ce USING (region), st GROUP BY region"""


def _region(df):
    return df.select("region_id", "n_points", F.round("mean_log_density", PLACES).alias("mean_log_density"), F.round(F.col("centroid")["c_acctbal"], 4).alias("centroid"), F.round("radius", PLACES).alias("radius"))


@_query("low_density_regions", _region_sql("low"))
def low_density_regions(spark, d):
    return _region(_accounts(spark, d).low_density_regions())


@_query("high_density_clusters", _region_sql("high"))
def high_density_clusters(spark, d):
    return _region(_accounts(spark, d).high_density_clusters())


@_query("low_density_table", _region_sql("low"))
def low_density_table(spark, d):
    return _region(plotdata.low_density_table(_accounts(spark, d)))


_REGIONS_2D = f"""WITH RECURSIVE st AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2, count(*) AS n, pow(count(*), -1.0 / 6) AS h FROM part),
z AS (SELECT p_partkey AS id, (p_size - m1) / s1 AS u, (p_retailprice - m2) / s2 AS v FROM part, st),
d AS (SELECT a.id, any_value(a.u) AS u, any_value(a.v) AS v, ln(sum(exp(-0.5 * (pow((a.u - b.u) / h, 2) + pow((a.v - b.v) / h, 2))))) - ln(any_value(n)) - 2 * ln(any_value(h)) - ln(2 * pi()) AS log_density FROM z a CROSS JOIN z b, st GROUP BY a.id),
c AS (SELECT * FROM d WHERE log_density < (SELECT quantile_cont(log_density, 0.1) FROM d)),
nb AS (SELECT a.id, b.id AS o FROM c a JOIN c b ON sqrt(pow(a.u - b.u, 2) + pow(a.v - b.v, 2)) <= 0.5 * sqrt(2)),
core AS (SELECT id FROM nb GROUP BY id HAVING count(*) >= 5),
link AS (SELECT id, o FROM nb WHERE id IN (SELECT id FROM core) AND o IN (SELECT id FROM core)),
reach AS (SELECT id, o FROM link UNION SELECT reach.id, link.o FROM reach JOIN link ON reach.o = link.id),
comp AS (SELECT id, min(o) AS least_id FROM reach GROUP BY id),
cl AS (SELECT id, dense_rank() OVER (ORDER BY least_id) - 1 AS region FROM comp),
al AS (SELECT id, region FROM cl UNION ALL SELECT nb.id, min(region) FROM nb JOIN cl ON nb.o = cl.id WHERE nb.id NOT IN (SELECT id FROM cl) GROUP BY nb.id),
ce AS (SELECT region, count(*) AS n_points, avg(log_density) AS l, avg(u) AS mu, avg(v) AS mv FROM al JOIN c USING (id) GROUP BY region)
SELECT region::BIGINT AS region_id, any_value(n_points) AS n_points, round(any_value(l), {PLACES}) AS mean_log_density, round(any_value(m1 + s1 * mu), 4) AS p_size, round(any_value(m2 + s2 * mv), 4) AS p_retailprice, round(max(sqrt(pow(u - mu, 2) + pow(v - mv, 2))), {PLACES}) AS radius
FROM al JOIN c USING (id) JOIN ce USING (region), st GROUP BY region"""


def _region_2d(df):
    centre = [F.round(F.col("centroid")[c], 4).alias(c) for c in ("p_size", "p_retailprice")]
    return df.select("region_id", "n_points", F.round("mean_log_density", PLACES).alias("mean_log_density"), *centre, F.round("radius", PLACES).alias("radius"))


@_query("low_density_regions_2d", _REGIONS_2D)
def low_density_regions_2d(spark, d):
    return _region_2d(_part_density(spark, d).low_density_regions())


@_query("high_density_clusters_2d", _REGIONS_2D.replace("log_density < (SELECT quantile_cont(log_density, 0.1) FROM d)", "log_density > (SELECT quantile_cont(log_density, 0.9) FROM d)"))
def high_density_clusters_2d(spark, d):
    return _region_2d(_part_density(spark, d).high_density_clusters())


@_query("gmm_row_density")
def gmm_row_density(spark, d):
    return _part_density(spark, d, method="gmm", n_components=3).row_density()


@_query("gmm_bic")
def gmm_bic(spark, d):
    fitted = _part_density(spark, d, method="gmm")
    fitted._fit()
    return spark.createDataFrame([(k, float(v)) for k, v in fitted.bic.items()], "n_components int, bic double")


#: Of two columns' z-scores the principal axes are the diagonals.
_PLANE = """WITH base AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2, corr(p_size, p_retailprice) AS r FROM part),
plane AS (SELECT (u + v) / sqrt(2) AS p, (u - v) / sqrt(2) AS q, r FROM (SELECT (p_size - m1) / s1 AS u, (p_retailprice - m2) / s2 AS v, r FROM part, base)),
pts AS (SELECT CASE WHEN r >= 0 THEN p ELSE q END AS p_size, CASE WHEN r >= 0 THEN q ELSE p END AS p_retailprice FROM plane),"""


@_query("pca_projection", _PLANE + _GRID.removeprefix("WITH").replace("FROM part", "FROM pts").replace("round(log_density, 6)", "round(log_density, 4)"))
def pca_projection(spark, d):
    return _grid(_part_density(spark, d).density_projection()["grid"], 4)
