"""Missingness reports on small tables whose answers are plain, and error paths."""

import math

import numpy as np
import pytest

from gaugewell.functions.special import chi2_upper, t_two_sided
from gaugewell.operators.clusters import MissingnessClusters, average_linkage, cut
from gaugewell.operators.columns import ColumnsMissingness
from gaugewell.operators.correlation import MissingnessCorrelation
from gaugewell.operators.rows import RowsMissingness

NAN = float("nan")


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 1.0, "x", None), (2, NAN, None, None), (3, None, "y", None), (4, 4.0, "", None), (5, float("inf"), "x", None)]
    return spark.createDataFrame(rows, "rid long, a double, b string, none string")


def test_columns(small):
    got = {r.column: r for r in ColumnsMissingness(small).summary().df.collect()}
    assert {c: r.missing_count for c, r in got.items()} == {"rid": 0, "a": 2, "b": 1, "none": 5}
    assert got["a"].missing_rate == 0.4 and got["b"].dtype == "string"
    assert [r.column for r in ColumnsMissingness(small).summary().df.collect()] == ["none", "a", "b", "rid"]


def test_columns_of_nothing(small):
    assert all(r.missing_rate == 0.0 for r in ColumnsMissingness(small.limit(0)).summary().df.collect())
    assert all(r.rates == 0.0 and r.counts == 0.0 for r in ColumnsMissingness(small.select()).stats().df.collect())


def test_stats_of_columns(small):
    got = {r.metric: (r.rates, r.counts) for r in ColumnsMissingness(small).stats().df.collect()}
    rates, counts = np.array([0, 0.4, 0.2, 1.0]), np.array([0, 2, 1, 5])
    assert got["mean"] == pytest.approx((rates.mean(), counts.mean())) and got["std"] == pytest.approx((rates.std(ddof=1), counts.std(ddof=1)))
    assert got["p95"] == pytest.approx((np.quantile(rates, 0.95), np.quantile(counts, 0.95)))


def test_rows(small):
    r = RowsMissingness(small, "rid")
    assert sorted(map(tuple, r.counts().collect())) == [(1, 1), (2, 3), (3, 2), (4, 1), (5, 1)]
    full = r.full_missing()
    assert full.df.first()["count"] == 1 and [x.rid for x in full.extra["indices"].collect()] == [2]
    above = r.missing_above(2 / 3, sample_size=1)
    assert above.df.first()["count"] == 2 and [x.rid for x in above.extra["indices"].collect()] == [2]
    assert r.missing_below(1 / 3).df.first()["count"] == 3
    assert sorted(map(tuple, r.completeness().df.collect())) == [(1, 3), (2, 1), (3, 1)]
    assert tuple(r.summary({"above": 0.5, "below": 0.5}).df.first()) == (5, 1, 2, 3)
    assert sorted(map(tuple, above.plot.collect())) == [("matching", 2), ("others", 3)]


@pytest.mark.parametrize("threshold", [-0.1, 1.1])
def test_thresholds_are_shares(small, threshold):
    for f in (RowsMissingness(small).missing_above, RowsMissingness(small).missing_below):
        with pytest.raises(ValueError):
            f(threshold)
    with pytest.raises(ValueError):
        RowsMissingness(small).summary({"above": threshold})


def test_empty_rows(small):
    r = RowsMissingness(small.limit(0), "rid").stats().df.first()
    assert set(r) == {0.0}


def test_correlations(spark):
    rows = [(i, None if i % 3 == 0 else 1.0, None if i % 3 == 0 else "p", float(i % 3 == 0) + 0.1 * (i % 5), "uv"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "rid long, a double, b string, v double, k string")
    c = MissingnessCorrelation(df, "rid")
    assert {(r.column_a, r.column_b): r["corr"] for r in c.missing_missing_corr().df.collect()}[("a", "b")] == 1.0
    got = {(r.missing_column, r.compared_to): r for r in c.missing_observed_corr().df.collect()}
    m, v = np.array([i % 3 == 0 for i in range(60)], float), np.array([r[3] for r in rows])
    assert got["a", "v"].statistic == pytest.approx(np.corrcoef(m, v)[0, 1], abs=5e-4) and got["a", "v"].p_value < 1e-6
    assert got["a", "k"].statistic == pytest.approx(0.0, abs=0.2) and got["a", "k"].method == "cramers_v"
    assert ("a", "a") not in got and ("v", "a") not in got
    with pytest.raises(ValueError):
        c.missing_target_corr("nope")


def test_tail_probabilities():
    # published tables: t of 2.228 with 10, chi-square 3.841 with 1 and 18.307 with 10 degrees
    assert t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert chi2_upper(0.5, 2) == pytest.approx(math.exp(-0.25)) and t_two_sided(1.0, 1) == pytest.approx(0.5)


def test_clusters(small):
    found = MissingnessClusters(small, "rid").clusters()
    assert found.varying_cols == ["a", "b"]
    table = found.table.collect()
    assert [(r.cluster_id, r["size"], r.missing_columns) for r in table] == [(0, 3, []), (1, 1, ["a"]), (2, 1, ["a", "b"])]
    assert sorted(map(tuple, found.labels.collect())) == [(1, 0), (2, 2), (3, 1), (4, 0), (5, 0)]
    assert [r.rid for r in MissingnessClusters(small, "rid").rows_in(2).collect()] == [2]
    for bad in (lambda: MissingnessClusters(small, "rid").rows_in(9), lambda: MissingnessClusters(small).clusters("other"), lambda: MissingnessClusters(small.select("rid")).clusters("hierarchical")):
        with pytest.raises(ValueError):
            bad()


def test_clusters_without_missing_values(small):
    found = MissingnessClusters(small.select("rid")).clusters()
    assert [(r.cluster_id, r["size"], r.missing_columns) for r in found.table.collect()] == [(0, 5, [])]
    assert tuple(MissingnessClusters(small.limit(0)).summary().first()) == (0, 0.0, 0.0)


def test_average_linkage():
    points = np.array([[0, 0, 0, 0], [0, 0, 0, 1], [1, 1, 1, 0], [1, 1, 1, 1]])
    merges = average_linkage(points)
    assert merges[:, 2].tolist() == pytest.approx([0.25, 0.25, 0.875]) and merges[-1, 3] == 4
    assert cut(merges, 4, 2) == [0, 0, 1, 1] and cut(merges, 4, 1) == [0, 0, 0, 0]
    assert cut(merges, 4, 3) == [0, 0, 1, 1]  # equal heights merge together
    assert cut(merges, 4, 4) == [0, 1, 2, 3]


@pytest.mark.parametrize("metric", ["hamming", "jaccard", "cityblock", "euclidean"])
def test_average_linkage_by_definition(metric):
    """Every merge joins the two clusters whose members are closest in the mean over all pairs."""
    import itertools

    import numpy as np

    from gaugewell.operators.clusters import average_linkage

    one = {
        "hamming": lambda a, b: sum(x != y for x, y in zip(a, b)) / len(a),
        "jaccard": lambda a, b: sum(x != y for x, y in zip(a, b)) / max(1, sum(x or y for x, y in zip(a, b))),
        "cityblock": lambda a, b: sum(abs(x - y) for x, y in zip(a, b)),
        "euclidean": lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5,
    }[metric]
    rnd = np.random.default_rng(7)
    points = np.unique(rnd.integers(0, 2, (14, 6)), axis=0)
    members = {i: [i] for i in range(len(points))}
    apart = lambda p, q: np.mean([one(points[a].tolist(), points[b].tolist()) for a in members[p] for b in members[q]])
    for k, (a, b, height, size) in enumerate(average_linkage(points, metric)):
        least = min(apart(p, q) for p, q in itertools.combinations(members, 2))
        assert height == pytest.approx(least) == pytest.approx(apart(int(a), int(b)))
        members[len(points) + k] = members.pop(int(a)) + members.pop(int(b))
        assert size == len(members[len(points) + k])
