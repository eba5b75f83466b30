"""Duplicates: planted cases built by arithmetic, error paths, and the pruned join against all pairs."""

import itertools
import math

import pytest

from pyspark.sql import functions as F

from gaugewell.operators.exact_dups import ExactDuplicates
from gaugewell.operators.near_dups import NearDuplicates
from gaugewell.plans.components import connected_components
from gaugewell.plans.ranking import with_rank

SCHEMA = "user_id long, amount double, category string, target long"


def base(n, start=0):
    return [(10_000 + i, 50.0 + i * 0.25, "abcd"[i % 4], i % 2) for i in range(start, start + n)]


def test_clean(spark):
    r = ExactDuplicates(spark.createDataFrame(base(500), SCHEMA), label_col="target").duplicate_rate().first()
    assert tuple(r) == (500, 0, 0.0, 0)


def test_within_split(spark):
    rows = base(500)
    d = ExactDuplicates(spark.createDataFrame(rows + rows[:15], SCHEMA))
    assert tuple(d.duplicate_rate().first()) == (515, 30, 30 / 515, 15)
    assert all(r["size"] == 2 and r.removable_rows == 1 for r in d.duplicate_groups().collect())


def test_splits(spark):
    train, val, test = base(500), base(150, 1000), base(150, 2000)
    val, test = val + train[:5], test + train[100:107]
    frames = {k: spark.createDataFrame(v, SCHEMA) for k, v in (("train", train), ("val", val), ("test", test))}
    d = ExactDuplicates.from_splits(frames, label_col="target")
    s = d.summary().first()
    assert s.n_groups == 12 and s.cross_split_groups == 12 and s.conflicting_groups == 0
    kinds = sorted(tuple(r.splits) for r in d.cross_split_overlap().collect())
    assert kinds.count(("train", "val")) == 5 and kinds.count(("test", "train")) == 7


def test_label_conflicts(spark):
    rows = base(500)
    extra = [(u, a, c, 1 - t) for u, a, c, t in rows[:8]] + rows[:8]
    d = ExactDuplicates(spark.createDataFrame(rows + extra, SCHEMA), label_col="target")
    got = d.label_conflicts().collect()
    assert len(got) == 8 and all(r["size"] == 3 and r.labels == [0, 1] and r.has_conflict for r in got)
    assert d.rows_in(got[0].group_id).count() == 3


def test_labels_sort_by_their_text(spark):
    d = ExactDuplicates(spark.createDataFrame([("k", 2), ("k", 10)], "a string, l long"), label_col="l")
    assert d.label_conflicts().first().labels == [10, 2]


def test_missing_equals_missing(spark):
    rows = [(float("nan"), None), (None, None), (1.0, "x")]
    assert ExactDuplicates(spark.createDataFrame(rows, "a double, b string")).duplicate_rate().first().n_groups == 1


def test_split_errors(spark):
    a, b = spark.createDataFrame(base(5), SCHEMA), spark.createDataFrame(base(5), SCHEMA.replace("amount", "amt"))
    for bad in (
        lambda: ExactDuplicates.from_splits({"train": a}),
        lambda: ExactDuplicates.from_splits({"train": a, "test": b}),
        lambda: ExactDuplicates.from_splits({"train": a.withColumnRenamed("category", "split"), "test": a.withColumnRenamed("category", "split")}),
        lambda: ExactDuplicates(a, split_col="nope"),
        lambda: ExactDuplicates(a).cross_split_overlap(),
        lambda: ExactDuplicates(a).label_conflicts(),
        lambda: ExactDuplicates(a).rows_in(99),
    ):
        with pytest.raises(ValueError):
            bad()


def test_group_ids_rank_all_identities(spark):
    d = ExactDuplicates(spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,), (None,)], "k string"))
    assert [(r.group_id, r["size"]) for r in d.duplicate_groups().collect()] == [(2, 2), (3, 2)]


def test_rank(spark):
    df = spark.range(1000).repartition(7)
    assert with_rank(df, [F.col("id").desc()], "r").where("r <> 999 - id").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()))
    assert got == {i: i // 20 * 20 for i in range(60)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def similarity(x, y, p, c):
    num = 1 - math.sqrt(sum((a - b) ** 2 for a, b in zip(x[:p], y[:p]))) / math.sqrt(p) if p else 0
    m = sum(a == b for a, b in zip(x[p:], y[p:]))
    cat = m / (2 * c - m) if c else 0
    return p / (p + c) * num + c / (p + c) * cat


@pytest.mark.parametrize("p,c,threshold", [(1, 1, 0.97), (2, 2, 0.9), (1, 3, 0.7), (1, 3, 0.85), (2, 0, 0.9), (0, 3, 0.5), (2, 1, 0.6)])
def test_pruned_join_is_all_pairs(spark, p, c, threshold):
    rows = [(i, (i * 37 % 101) / 100, (i * 53 % 89) / 88, *[("ab"[i // 2 % 2], "xyz"[i % 3], "uvwk"[i % 4])[k] for k in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, n0 double, n1 double, c0 string, c1 string, c2 string")
    numeric, categorical = ["n0", "n1"][:p], ["c0", "c1", "c2"][:c]
    near = NearDuplicates(df, "id", numeric, categorical, threshold=threshold)
    got = {(r.row_i, r.row_j): r.similarity for r in near.find_pairs().collect()}
    low = [min(r[1 + k] for r in rows) for k in range(p)]
    high = [max(r[1 + k] for r in rows) for k in range(p)]
    want = {}
    for a, b in itertools.combinations(rows, 2):
        x, y = ([(r[1 + k] - low[k]) / (high[k] - low[k]) for k in range(p)] + list(r[3 : 3 + c]) for r in (a, b))
        s = similarity(x, y, p, c)
        if s >= threshold:
            want[a[0], b[0]] = s
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=6e-5) for k in got)


@pytest.mark.parametrize("how", [dict(threshold=0.3, max_exact_rows=None), dict(threshold=0.9, method="lsh", block_cols=["c"])])
def test_large_keys_in_blocks(spark, monkeypatch, how):
    """One key holds a third of the rows, or all: dealt into blocks, the pairs are the same."""
    from gaugewell.operators import near_dups

    rows = [(i, float(i * 37 % 101), None if i % 3 else "hot" if i % 2 else f"k{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, n double, c string").repartition(3)
    found = []
    for block in (4096, 16):
        monkeypatch.setattr(near_dups, "BLOCK", block)
        found.append(sorted((r.row_i, r.row_j, r.similarity) for r in NearDuplicates(df, "id", ["n"], ["c"], **how).find_pairs().collect()))
    assert found[0] == found[1] and len(found[0]) == len(set(found[0])) > 100


def test_near_missing_values(spark):
    rows = [(1, 1.0, None), (2, 1.0, None), (3, None, None), (4, 2.0, "x")]
    got = NearDuplicates(spark.createDataFrame(rows, "id long, n double, c string"), "id", threshold=1.0).find_pairs().collect()
    assert [(r.row_i, r.row_j, r.similarity, r.n_differing) for r in got] == [(1, 2, 1.0, 0)]


def test_near_errors(spark):
    df = spark.createDataFrame([(i, float(i), "a") for i in range(30)], "id long, n double, c string")
    for how in (dict(numeric_cols=["n"], categorical_cols=["n"]), dict(numeric_cols=[], categorical_cols=[]), dict(method="other"), dict(threshold=0.0), dict(threshold=1.5), dict(numeric_cols=["n"], method="lsh"), dict(threshold=0.2, max_exact_rows=10), dict(categorical_cols=["nope"])):
        with pytest.raises(ValueError):
            NearDuplicates(df, "id", **how)


def test_scope_with_missing_splits(spark):
    rows = [(1, "k", "t"), (2, "k", None), (3, "k", None)]
    near = NearDuplicates(spark.createDataFrame(rows, "id long, c string, split string"), "id", categorical_cols=["c"], split_col="split")
    assert tuple(near.pairs_by_scope().first()) == (1, 2, 2 / 3)


def test_ratio(spark):
    df = spark.createDataFrame([(i, "k" if i < 3 else f"o{i}") for i in range(6)], "id long, c string")
    r = NearDuplicates(df, "id", categorical_cols=["c"]).near_vs_exact_ratio(ExactDuplicates(df, id_col="id")).first()
    assert tuple(r) == (3, 3, 1.0)


def test_quantiles(spark, monkeypatch):
    import numpy as np

    from gaugewell.plans import ranking

    monkeypatch.setattr(ranking, "FEW", 10)
    monkeypatch.setattr(ranking, "CELLS", 16)
    rnd = np.random.default_rng(2)
    for values in (rnd.normal(size=2001), np.repeat([1.0, 2.0], 300), np.concatenate([rnd.normal(size=300) * 1e-9, [1e9, -1e9]]), np.array([5.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
        shares = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
        assert ranking.quantiles(df, "x", shares) == pytest.approx([float(np.quantile(values, s)) for s in shares], rel=1e-12, abs=1e-18)
    assert ranking.quantiles(df.where("x > 9"), "x", [0.5]) == [None]


def test_intermediate_tables_go(spark):
    import os

    from gaugewell.sources.shared import clean, materialise, shared_dir

    clean(spark)
    kept = materialise(spark.range(5), "kept")
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in connected_components(links).collect()} == {0}
    assert clean(spark) == 2  # the last round's and the one above
    assert not os.path.exists(kept._gaugewell_path) and os.path.isdir(shared_dir(spark))


def test_copies_are_counted_as_classes(spark, monkeypatch):
    """2,000 copies of each row: 10^7 pairs and more are counted from a few pairs of classes; expanded, they are those of the definition."""
    from gaugewell.operators import near_dups

    rows = [(k, float(k % 3 * 10 + k % 2 * 0.1), "ab"[k % 2 if k > 3 else 0], "xy"[k % 2], "pq"[k % 3 == 0]) for k in range(5)]
    few, copies = spark.createDataFrame(rows, "k long, n double, c string, split string, label string"), 2000
    df = few.crossJoin(spark.range(copies).select(F.col("id").alias("r"))).withColumn("id", F.col("k") + 5 * F.col("r")).drop("k", "r")
    near = NearDuplicates(df, "id", ["n"], ["c"], split_col="split", label_col="label", threshold=0.97)
    same = [(a, b) for a, b in itertools.combinations(rows, 2) if a[2] == b[2] and abs(a[1] - b[1]) / 20.1 <= 0.06]
    cross = sum(copies * copies for a, b in same if a[3] != b[3])
    whole = len(same) * copies * copies + 5 * copies * (copies - 1) // 2
    assert same and cross and tuple(near.pairs_by_scope().first())[:2] == (whole - cross, cross) and near.summary().first().n_pairs == whole
    assert near._counted().count() == len(same) + 5

    monkeypatch.setattr(near_dups, "BLOCK", 4)
    small = df.where("id < 50")
    got = NearDuplicates(small, "id", ["n"], ["c"], split_col="split", label_col="label", threshold=0.97).pairs().collect()
    of = {r.id: r for r in small.collect()}
    for p in got:
        assert p.row_i < p.row_j and (p.split_i, p.split_j, p.label_i, p.label_j) == (of[p.row_i].split, of[p.row_j].split, of[p.row_i].label, of[p.row_j].label)
    kept = {(a[0], b[0]) for a, b in same}
    want = {(i, j) for i, j in itertools.combinations(range(50), 2) if i % 5 == j % 5 or tuple(sorted((i % 5, j % 5))) in kept}
    assert len(got) == len(want) and {(p.row_i, p.row_j) for p in got} == want


def test_near_repeated_ids(spark):
    """Rows of one id don't pair with each other; each pairs with the rows of other ids."""
    rows = [(1, 1.0, "a"), (1, 1.0, "a"), (1, 1.0, "b"), (2, 1.0, "a"), (None, 1.0, "a")]
    near = NearDuplicates(spark.createDataFrame(rows, "id long, n double, c string"), "id", threshold=0.9)
    assert [(r.row_i, r.row_j) for r in near.find_pairs().collect()] == [(1, 2), (1, 2)] and near.summary().first().n_pairs == 2
