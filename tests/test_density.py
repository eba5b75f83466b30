"""Density: kernels integrate to one, clusters follow the definition, mixtures behave."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewell import plotdata
from gaugewell.operators.density import KERNELS, ORDER, DensityEstimate, cell_sums, dbscan, gmm_log_density, kde_log_density
from gaugewell.plans.ranking import quantiles


@pytest.mark.parametrize("kernel", KERNELS)
def test_kernels_integrate_to_one(kernel):
    x = np.linspace(-30, 30, 24001)[:, None]
    assert np.exp(kde_log_density(x, np.array([[0.0], [1.0]]), 0.7, kernel)).sum() * (x[1, 0] - x[0, 0]) == pytest.approx(1, abs=2e-3)
    g = np.linspace(-9, 9, 401)
    xy = np.stack(np.meshgrid(g, g), axis=-1).reshape(-1, 2)
    assert np.exp(kde_log_density(xy, np.zeros((1, 2)), 0.7, kernel)).sum() * (g[1] - g[0]) ** 2 == pytest.approx(1, abs=1e-2)


def plain_dbscan(points, eps, least):
    ids = sorted(points)
    near = {i: [j for j in ids if sum((a - b) ** 2 for a, b in zip(points[i], points[j])) ** 0.5 <= eps] for i in ids}
    core, label, n = [i for i in ids if len(near[i]) >= least], {}, 0
    for i in core:
        if i not in label:
            todo, label[i] = [i], n
            while todo:
                for j in near[todo.pop()]:
                    if j in core and j not in label:
                        label[j] = n
                        todo.append(j)
            n += 1
    for i in ids:
        if i not in core and any(j in core for j in near[i]):
            label[i] = min(label[j] for j in near[i] if j in core)
    return label


@pytest.mark.parametrize("d,seed", [(1, 0), (2, 1), (4, 2)])
def test_dbscan(spark, d, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.uniform(-3, 3, (5, d))
    points = {int(i): tuple(map(float, centres[i % 5] + rnd.normal(0, 0.35, d))) for i in rnd.permutation(120)}
    df = spark.createDataFrame([(i, *v) for i, v in points.items()], "id long, " + ", ".join(f"z{k} double" for k in range(d)))
    got = dict(map(tuple, dbscan(df, [f"z{k}" for k in range(d)], 0.4, 4).collect()))
    assert got == plain_dbscan(points, 0.4, 4)


@pytest.mark.parametrize("d,seed,spread,eps", [(1, 5, 0.05, 0.1), (2, 6, 0.25, 0.3), (2, 7, 0.02, 0.5), (3, 8, 0.3, 0.45)])
def test_dbscan_of_dense_cells(spark, d, seed, spread, eps):
    """Cells of many rows, chains of cells, copies, and borders between regions."""
    rnd = np.random.default_rng(seed)
    line = np.cumsum(rnd.uniform(0.5 * eps, 1.05 * eps, (60, 1)) / d**0.5 * np.ones(d), axis=0)
    centres = rnd.uniform(-2, 2, (6, d))
    rows = np.concatenate([line, centres[rnd.integers(0, 6, 300)] + rnd.normal(0, spread, (300, d)), np.repeat(centres[:1], 20, axis=0)])
    points = {int(i): tuple(map(float, v)) for i, v in zip(rnd.permutation(len(rows)), rows)}
    df = spark.createDataFrame([(i, *v) for i, v in points.items()], "id long, " + ", ".join(f"z{k} double" for k in range(d)))
    got = dict(map(tuple, dbscan(df, [f"z{k}" for k in range(d)], eps, 4).collect()))
    assert got == plain_dbscan(points, eps, 4)


@pytest.fixture(scope="module")
def blobs(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, float(rnd.normal(0 if i % 2 else 10, 1)), float(rnd.normal(0 if i % 2 else 10, 1)), "t") for i in range(400)]
    return spark.createDataFrame(rows, "id long, x double, y double, s string")


def test_mixture_finds_two_blobs(blobs):
    m = DensityEstimate(blobs, "id", method="gmm", max_components=3)
    scores = {r.id: r.log_density for r in m.row_density().collect()}
    assert min(m.bic, key=m.bic.get) == 2 and len(scores) == 400
    middle = m.score(blobs.limit(1).select("id", F.lit(5.0).alias("x"), F.lit(5.0).alias("y"))).first().log_density
    assert middle < min(scores.values())


def test_one_component_is_the_normal_density():
    x = np.array([[0.5, -1.0]])
    want = -0.5 * (x**2).sum() - np.log(2 * np.pi)
    assert gmm_log_density(x, [1.0], [np.zeros(2)], [np.eye(2)])[0] == pytest.approx(want, abs=1e-6)


def test_reports(blobs):
    k = DensityEstimate(blobs, "id", ["x", "y"])
    s = k.density_summary().first()
    assert s.n_rows == 400 and s.n_dims == 2 and s.pct_rows_low_density == pytest.approx(0.1)
    assert sum(r.n_points for r in k.high_density_clusters().collect()) <= 40
    assert set(k.high_density_clusters().first().centroid) == {"x", "y"}
    assert k.density_grid(("x", "y"), 10).count() == 100
    p = k.density_projection(resolution=5)
    assert sum(p["explained_variance"]) == pytest.approx(1) and p["grid"].count() == 25


@pytest.mark.parametrize("kernel", ["gaussian", "linear"])
def test_every_row_counts(spark, kernel):
    """More rows than the sample once was."""
    table = spark.range(60_000).select("id", F.pow(F.col("id") / 60_000, F.lit(2.0)).alias("x"))
    points = spark.createDataFrame([(-0.5,), (0.01,), (0.4,), (0.9,)], "x double")
    x = (np.arange(60_000) / 60_000)[:, None] ** 2
    want = kde_log_density((np.array([[-0.5], [0.01], [0.4], [0.9]]) - x.mean()) / x.std(), (x - x.mean()) / x.std(), 60_000**-0.2, kernel)
    got = {r.x: r.log_density for r in DensityEstimate(table, "id", ["x"], kernel=kernel).score(points).collect()}
    assert [got[v] for v in (-0.5, 0.01, 0.4, 0.9)] == pytest.approx(list(want), abs=1e-9)


def test_errors(spark, blobs):
    holes = spark.createDataFrame([(1, None), (2, 1.0)], "id long, x double")
    for bad in (
        lambda: DensityEstimate(blobs, "id", ["nope"]),
        lambda: DensityEstimate(blobs, "id", ["s"]),
        lambda: DensityEstimate(blobs, "id", method="other"),
        lambda: DensityEstimate(blobs, "id", []),
        lambda: DensityEstimate(holes, "id"),
        lambda: DensityEstimate(blobs, "id", ["x"]).density_grid(("x", "y")),
        lambda: DensityEstimate(blobs, "id", ["x"]).density_1d("y"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_many_rows_by_cells(spark):
    """All pairs of 150,000 rows would take minutes; the sums are those of all pairs."""
    n = 150_000
    table = spark.range(n).select("id", F.pow(F.col("id") / n, F.lit(2.0)).alias("x"), F.sin(F.col("id") * 0.37).alias("y"))
    began = time.time()
    got = {r.id: r.log_density for r in DensityEstimate(table, "id", ["x", "y"]).row_density().where("id % 5000 = 7").collect()}
    assert time.time() - began < 60
    i = np.arange(n)
    z = np.column_stack([(i / n) ** 2, np.sin(i * 0.37)])
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    own = sorted(got)
    assert len(own) == n // 5000 and [got[k] for k in own] == pytest.approx(list(kde_log_density(z[own], z, n ** (-1 / 6))), abs=1e-9)


@pytest.mark.parametrize("d", [1, 2])
def test_far_points_and_copies(spark, d):
    """Points beyond all kernels, rows far from the others, and rows of one value by the hundred."""
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(size=(300, d)), np.repeat([[2.5] * d], 400, axis=0), [[60.0] * d]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"x{k} double" for k in range(d)))
    points = [(0, *[1e4] * d), (1, *[30.0] * d), (2, *[-8.0] * d), (3, *[2.5] * d), (4, *[60.0] * d), (5, *[None] * d)]
    model = DensityEstimate(df, "id", bandwidth=0.05)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    at = (np.array([p[1:] for p in points[:5]]) - x.mean(axis=0)) / x.std(axis=0)
    got = {r.id: r.log_density for r in model.score(spark.createDataFrame(points, df.schema)).collect()}
    assert [got[k] for k in range(5)] == pytest.approx(list(kde_log_density(at, z, 0.05)), rel=1e-10, abs=1e-9) and np.isnan(got[5])
    own = {r.id: r.log_density for r in model.row_density().collect()}
    assert [own[k] for k in range(len(x))] == pytest.approx(list(kde_log_density(z, z, 0.05)), abs=1e-9)


@pytest.mark.parametrize("gap, regions", [(1.002, 2), (0.999, 1)])
def test_regions_that_nearly_touch(spark, gap, regions):
    """Two dense regions whose nearest rows lie just within or beyond eps: their pairs of rows are 3.6 billion."""
    n = 60_000
    x = F.when(F.col("id") % 2 == 0, -F.col("id") * 1e-7).otherwise(F.lit(gap) + F.col("id") * 1e-7)
    points = spark.range(2 * n).select("id", x.alias("x"), (F.col("id") % 7 * 1e-6).alias("y"))
    began = time.time()
    got = {r.region: r.n for r in dbscan(points, ["x", "y"], 1.0, 5).groupBy("region").agg(F.count("*").alias("n")).collect()}
    assert time.time() - began < 90
    assert got == ({0: n, 1: n} if regions == 2 else {0: 2 * n})


@pytest.mark.parametrize("copies", [[1] * 149, [9] * 20, [2, 5, 400]])
def test_low_density_share_counts_rows(spark, copies):
    """Whole numbers of rows, and copies of the row at the threshold are all above it."""
    x = np.repeat(np.arange(len(copies)) ** 1.5, copies)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double").repartition(3)
    model = DensityEstimate(df, "id", ["x"])
    got = {r.part: r.rows for r in plotdata.low_density_share(model).collect()}
    z = ((x - x.mean()) / x.std())[:, None]
    density = np.round(kde_log_density(z, z, len(x) ** -0.2), 9)
    place = 0.1 * (len(x) - 1)
    a, b = np.sort(density)[[int(place), int(np.ceil(place))]]
    low = int((density < (a if a == b else a + (place - int(place)) * (b - a))).sum())
    assert got == {"low_density": low, "others": len(x) - low}
    s = model.density_summary().first()
    assert (s.n_rows, s.pct_rows_low_density) == (len(x), low / len(x))
    assert (s.log_density_min, s.log_density_mean, s.log_density_median) == pytest.approx((density.min(), density.mean(), np.median(density)), abs=1e-8)
    model.row_density()
    model._counted = None  # by rows, as where the rows' densities are known
    assert {r.part: r.rows for r in plotdata.low_density_share(model).collect()} == got


@pytest.mark.parametrize("d", [1, 2])
def test_equal_points_get_equal_sums(d):
    rnd = np.random.default_rng(0)
    for n in range(1, 40):
        point, c = rnd.uniform(-0.25, 0.25, (1, d)), rnd.normal(size=ORDER**d)
        assert set(cell_sums(np.repeat(point, n, axis=0), c)) == set(cell_sums(point, c))


def test_quantiles_of_copies_and_weights(spark):
    """Between equal values lies that value, to the last place; weights count as copies."""
    rnd = np.random.default_rng(1)
    values = [-float(v) for v in rnd.random(3) * 8]
    shares = [float(s) for s in rnd.random(300) * 0.3]
    df = spark.createDataFrame([(v, 1000) for v in values], "x double, w long")
    assert set(quantiles(df, "x", shares, "w")) == {min(values)}
    weights = rnd.integers(1, 9, 50)
    x = rnd.normal(size=50)
    df = spark.createDataFrame([(float(v), int(w)) for v, w in zip(x, weights)], "x double, w long")
    shares = [0.0, 0.1, 0.37, 0.5, 1.0]
    assert quantiles(df, "x", shares, "w") == pytest.approx(list(np.quantile(np.repeat(x, weights), shares)), abs=1e-12)
