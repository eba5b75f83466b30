"""Rows grouped by what they miss."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.base import Analyzer, require_column
from gaugewell.functions.missing import col, flag
from gaugewell.plans.ranking import with_rank

#: Signatures that hierarchical clustering takes to the driver at most.
MOST_SIGNATURES = 5000


@dataclass
class ClusterResult:
    """table(cluster_id, size, rate, n_missing_cols, missing_columns), labels(id, cluster_id), pattern(cluster_id, column, fraction)."""

    table: DataFrame
    labels: DataFrame
    pattern: DataFrame
    varying_cols: list[str]
    method: str
    linkage: np.ndarray | None = None
    meta: dict = field(default_factory=dict)


def average_linkage(points: np.ndarray, metric: str = "hamming") -> np.ndarray:
    """Merges (a, b, height, size) of unweighted average linkage; new clusters are numbered from len(points) on."""
    x = points.astype(float)
    n = len(x)
    if metric == "hamming":
        d = np.stack([(x != r).mean(axis=1) for r in x])
    elif metric == "jaccard":
        either = np.stack([((x > 0) | (r > 0)).sum(axis=1) for r in x])
        d = np.stack([(x != r).sum(axis=1) for r in x]) / np.maximum(either, 1)
    elif metric == "cityblock":
        d = np.stack([np.abs(x - r).sum(axis=1) for r in x])
    elif metric == "euclidean":
        d = np.stack([np.sqrt(((x - r) ** 2).sum(axis=1)) for r in x])
    else:
        raise ValueError(f"unknown metric {metric!r}")
    np.fill_diagonal(d, np.inf)
    name, size, out = np.arange(n), np.ones(n), []
    for k in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        out.append((*sorted((name[i], name[j])), d[i, j], size[i] + size[j]))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i] = n + k
    return np.array(out, dtype=float).reshape(-1, 4)


def cut(linkage: np.ndarray, n: int, k: int) -> list[int]:
    """Labels at the lowest height that leaves k clusters at most (equal heights merge together)."""
    parent = list(range(2 * n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    left = n
    height = -np.inf
    for m, (a, b, h, _) in enumerate(linkage):
        if left <= k and h > height:
            break
        parent[root(int(a))] = parent[root(int(b))] = n + m
        left, height = left - 1, h
    roots = [root(i) for i in range(n)]
    order = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return [order[r] for r in roots]


class MissingnessClusters(Analyzer):
    id = "dataset.missingness.clusters"
    capability = "missingness.row_clusters"
    provides = ("missingness.row_clusters",)

    def __init__(self, df: DataFrame, id_col: str | None = None):
        require_column(df, id_col, "id_col")
        self.df, self.id_col = df, id_col
        self.columns = [c for c in df.columns if c != id_col]
        self._vary: list[str] | None = None

    def varying(self) -> list[str]:
        """Columns with both missing and present values."""
        if self._vary is None:
            row = self.df.agg(F.count("*"), *[F.sum(flag(self.df, c)) for c in self.columns]).first()
            self.n = row[0]
            self._vary = [c for c, m in zip(self.columns, row[1:]) if m and m < self.n]
        return self._vary

    def _signature(self):
        vary = self.varying()
        return F.concat(*[flag(self.df, c).cast("string") for c in vary]) if vary else F.lit("")

    def clusters(self, method: str = "exact", k: int = 8, metric: str = "hamming") -> ClusterResult:
        if method not in ("exact", "hierarchical"):
            raise ValueError(f"method must be 'exact' or 'hierarchical', not {method!r}")
        vary = self.varying()
        signatures = self.df.groupBy(self._signature().alias("signature")).agg(F.count("*").alias("rows"))
        linkage = None
        if method == "exact":
            named = with_rank(signatures, [F.desc("rows"), F.col("signature")], "cluster_id").select("signature", "rows", F.col("cluster_id").cast("int").alias("cluster_id"))
        else:
            got = signatures.orderBy("signature").limit(MOST_SIGNATURES + 1).collect()
            if len(got) < 2:
                raise ValueError("hierarchical clustering needs two signatures at least")
            if len(got) > MOST_SIGNATURES:
                raise ValueError(f"more than {MOST_SIGNATURES} signatures: use method='exact'")
            points = np.array([[int(x) for x in r["signature"]] for r in got])
            linkage = average_linkage(points, metric)
            label = cut(linkage, len(got), max(1, min(k, len(got))))
            size: dict[int, int] = {}
            for r, l in zip(got, label):
                size[l] = size.get(l, 0) + r["rows"]
            order = {l: i for i, l in enumerate(sorted(size, key=lambda l: (-size[l], l)))}  # labels go by least signature
            named = self.df.sparkSession.createDataFrame([(r["signature"], r["rows"], order[l]) for r, l in zip(got, label)], "signature string, rows long, cluster_id int")
        # share of the cluster's rows that miss each column
        bit = lambda i: F.substring("signature", i + 1, 1).cast("int")
        sums = named.groupBy("cluster_id").agg(F.sum("rows").alias("size"), *[(F.sum(bit(i) * F.col("rows")) / F.sum("rows")).alias(f"f{i}") for i in range(len(vary))])
        share = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("fraction")) for i, c in enumerate(vary)]) if vary else F.array().cast("array<struct<column:string,fraction:double>>")
        sums = sums.select("cluster_id", "size", share.alias("share"))
        missing = F.transform(F.filter("share", lambda x: x["fraction"] > 0.5), lambda x: x["column"])
        table = sums.select("cluster_id", "size", (F.col("size") / F.lit(max(self.n, 1))).alias("rate"), F.size(missing).alias("n_missing_cols"), missing.alias("missing_columns")).orderBy("cluster_id")
        pattern = sums.select("cluster_id", F.explode("share").alias("x")).select("cluster_id", "x.column", "x.fraction")
        ids = [col(self.id_col).alias(self.id_col)] if self.id_col else []
        labels = self.df.select(*ids, self._signature().alias("__sig")).join(named.select(F.col("signature").alias("__sig"), "cluster_id"), "__sig").drop("__sig")
        return ClusterResult(table, labels, pattern, vary, method, linkage, {"named": named, "k": k, "metric": metric})

    def pattern_matrix(self, method: str = "exact", k: int = 8, metric: str = "hamming") -> DataFrame:
        return self.clusters(method, k, metric).pattern

    def dendrogram(self, k: int = 8, metric: str = "hamming") -> ClusterResult:
        return self.clusters("hierarchical", k, metric)

    def rows_in(self, cluster_id: int, method: str = "exact", k: int = 8, metric: str = "hamming") -> DataFrame:
        """The table's rows in a cluster."""
        named = self.clusters(method, k, metric).meta["named"]
        found = [r["signature"] for r in named.where(F.col("cluster_id") == cluster_id).select("signature").collect()]
        if not found:
            raise ValueError(f"no cluster {cluster_id}")
        return self.df.where(self._signature().isin(found))

    def summary(self, *, method: str = "exact", k: int = 8, metric: str = "hamming") -> DataFrame:
        """One row: n_clusters, largest_cluster_rate, complete_rows_rate."""
        result = self.clusters(method, k, metric)
        complete = F.coalesce(F.sum(F.when(~F.col("signature").contains("1"), F.col("rows"))), F.lit(0)) / F.lit(max(self.n, 1))
        whole = result.meta["named"].agg(complete.alias("complete_rows_rate"))
        return result.table.agg(F.count("*").alias("n_clusters"), F.coalesce(F.max("rate"), F.lit(0.0)).alias("largest_cluster_rate")).join(whole)

    def chart(self, method: str = "exact", k: int = 8, metric: str = "hamming") -> DataFrame:
        """The 15 largest clusters, each described by its first three missing columns."""
        more = F.size("missing_columns") - 3
        text = F.when(F.size("missing_columns") == 0, F.lit("complete rows")).otherwise(F.concat(F.array_join(F.slice("missing_columns", 1, 3), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(F.lit(""))))
        return self.clusters(method, k, metric).table.orderBy("cluster_id").limit(15).select("cluster_id", "size", "rate", text.alias("description"))
