"""Density estimates and regions of low and high density.

Kernel densities take mean, deviation and number from an aggregate over all rows, and
the kernels' sums over all rows. Gaussian kernels over one or two columns are summed by
cells: moments of a cell's rows are moved to the cells within reach and evaluated there
(the fast Gauss transform), to rounding; points too far from all rows for that meet blocks
of rows, pruned by distance. Other kernels and more columns: blocks of points meet all
blocks of the table's z-scores. ``sample_for_fit`` bounds them to a sample of so many rows where asked. Mixtures are
fitted on a bounded sample (MIXTURE_SAMPLE unless asked otherwise). Regions are density-based clusters of the rows
beyond a quantile, found by joining neighbouring cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.base import Analyzer, require_column
from gaugewell.functions.missing import col, missing, number
from gaugewell.plans.components import connected_components
from gaugewell.plans.ranking import quantiles, with_rank
from gaugewell.sources.shared import discard, materialise

KERNELS = ("gaussian", "tophat", "epanechnikov", "exponential", "linear", "cosine")
#: Points scored at once against the sample: bounds the memory to POINTS * sample doubles.
POINTS = 128
#: Rows of a block of the table, and of a block of points that meets it.
BLOCK = 8192
POINT_BLOCK = 1024
#: Rows that mixtures are fitted on where sample_for_fit is None.
MIXTURE_SAMPLE = 50_000
#: Side of a kernel cell in bandwidths, terms of its expansion in a dimension, cells of a tile's side, log of the share that may be lost.
SIDE, ORDER, TILE, LOST = 0.5, 20, 64, 34.0
#: Cells of a block's side where points meet rows one by one, points of such a block, cells a task holds sums of.
NEAR, FEW_POINTS, HELD = 4, 256, 4096
#: Parts of a cell's side, and what rounding may add to a length.
CELL_PARTS = 4
SLACK = 1e-9
#: Pairs of rows that are compared at once; boxes of more are halved, so often at most.
FEW_PAIRS, HALVINGS = 4_000_000, 40


def _log_ball(d: int) -> float:
    """Log volume of the unit ball."""
    return 0.5 * d * math.log(math.pi) - math.lgamma(0.5 * d + 1)


def _log_norm(kernel: str, d: int) -> float:
    """Log integral of a kernel of width 1 over d dimensions."""
    ball, sphere = _log_ball(d), _log_ball(d) + math.log(d)
    if kernel == "gaussian":
        return 0.5 * d * math.log(2 * math.pi)
    if kernel == "tophat":
        return ball
    if kernel == "epanechnikov":
        return ball + math.log(2 / (d + 2))
    if kernel == "exponential":
        return sphere + math.lgamma(d)
    if kernel == "linear":
        return ball - math.log(d + 1)
    # cosine: r^(d-1) cos(pi r / 2) over [0, 1], by quadrature that is exact to rounding
    x, w = np.polynomial.legendre.leggauss(64)
    r = 0.5 * (x + 1)
    return sphere + math.log(float((0.5 * w * r ** (d - 1) * np.cos(0.5 * np.pi * r)).sum()))


def kde_log_density(points: np.ndarray, sample: np.ndarray, h: float, kernel: str = "gaussian", weights: np.ndarray | None = None) -> np.ndarray:
    n, d = sample.shape
    weights = np.ones(n) if weights is None else weights
    out = np.empty(len(points))
    for a in range(0, len(points), POINTS):
        q = points[a : a + POINTS]
        r2 = np.zeros((len(q), n))
        for k in range(d):
            r2 += (q[:, k, None] - sample[None, :, k]) ** 2
        if kernel == "gaussian":
            e = -r2 / (2 * h * h)
        else:
            r = np.sqrt(r2) / h
            with np.errstate(divide="ignore", invalid="ignore"):
                e = {
                    "tophat": lambda: np.where(r < 1, 0.0, -np.inf),
                    "epanechnikov": lambda: np.log(np.where(r < 1, 1 - r * r, 0.0)),
                    "exponential": lambda: -r,
                    "linear": lambda: np.log(np.where(r < 1, 1 - r, 0.0)),
                    "cosine": lambda: np.log(np.where(r < 1, np.cos(0.5 * np.pi * r), 0.0)),
                }[kernel]()
        top = e.max(axis=1, keepdims=True)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            out[a : a + POINTS] = np.log((np.exp(e - safe) * weights).sum(axis=1)) + safe[:, 0]
    return out - math.log(weights.sum()) - d * math.log(h) - _log_norm(kernel, d)


def moved(shift: float) -> np.ndarray:
    """What turns moments sum w exp(-v^2 / 2) v^k about a centre into coefficients sum w exp(-y^2 / 2) y^j / j! about one that lies shift farther, y = v - shift."""
    out = np.zeros((ORDER, ORDER))
    for j in range(ORDER):
        for k in range(ORDER):
            out[j, k] = sum(math.comb(j, i) * (-shift) ** (j - i) * shift ** (k - i) / math.factorial(k - i) for i in range(min(j, k) + 1)) / math.factorial(j)
    return out * math.exp(-0.5 * shift * shift)


def cell_moments(v: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """sum w exp(-|v|^2 / 2) v^k of one- or two-dimensional rows, in bandwidths from the cell's centre."""
    w, powers = weights * np.exp(-0.5 * (v * v).sum(axis=1)), [np.vander(x, ORDER, increasing=True) for x in v.T]
    return w @ powers[0] if len(powers) == 1 else (powers[0] * w[:, None]).T @ powers[1]


def cell_sums(v: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """The kernels' sums at points of a cell, from its coefficients. Elementwise steps alone: equal points get equal sums, wherever they stand."""
    s = coefficients.reshape(*[ORDER] * v.shape[1], 1)
    for x in v.T.copy():
        s = _polynomial(s, x)
    return s * np.exp(-0.5 * (v * v).sum(axis=1))


def _polynomial(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """sum c[k] x^k."""
    out = c[-1] * x
    for k in range(len(c) - 2, 0, -1):
        out += c[k]
        out *= x
    return out + c[0]


def tile_coefficients(cells: np.ndarray, moments: np.ndarray, wanted: np.ndarray, reach: int) -> np.ndarray:
    """Coefficients of the wanted cells of a tile, all within TILE of each other, from moments of all cells within reach."""
    d, low = wanted.shape[1], wanted.min(axis=0)
    span = wanted.max(axis=0) - low + 1
    inside = ((cells >= low - reach) & (cells < low + span + reach)).all(axis=1)
    at = (cells[inside] - low + reach).T
    x = np.zeros((*(span + 2 * reach), ORDER**d))
    np.add.at(x, tuple(at), moments[inside])
    shifts = [moved(-SIDE * step) for step in range(-reach, reach + 1)]
    if d == 1:
        return sum(x[a : a + span[0]] @ t.T for a, t in enumerate(shifts))[wanted[:, 0] - low[0]]
    x = np.ascontiguousarray(np.moveaxis(x.reshape(*x.shape[:2], ORDER, ORDER), 2, 0))  # order, cell, cell, order
    x = sum(np.tensordot(t, x[:, a : a + span[0]], 1) for a, t in enumerate(shifts))
    x = sum(x[:, :, a : a + span[1]] @ t.T for a, t in enumerate(shifts))
    return np.moveaxis(x, 0, 2)[wanted[:, 0] - low[0], wanted[:, 1] - low[1]].reshape(len(wanted), -1)


def _runs(keys: np.ndarray, most: int):
    """(start, end) of the runs of equal keys, of most rows at most."""
    cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
    for a, b in zip(cuts, cuts[1:]):
        for start in range(a, b, most):
            yield start, min(start + most, b)


def _floats(batch, first: int, n: int) -> np.ndarray:
    return np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(n)])


def _packed(batch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes):
    return pa.ipc.open_stream(data).read_next_batch()


def gmm_log_density(points: np.ndarray, weights, means, covariances) -> np.ndarray:
    parts = []
    for w, m, c in zip(weights, means, covariances):
        root = np.linalg.cholesky(c + 1e-9 * np.eye(len(c)))
        z = np.linalg.solve(root, (points - m).T)
        parts.append(math.log(max(w, 1e-300)) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * len(c) * math.log(2 * math.pi))
    parts = np.stack(parts)
    top = parts.max(axis=0)
    return top + np.log(np.exp(parts - top).sum(axis=0))


def dbscan(points: DataFrame, dims: list[str], eps: float, min_samples: int) -> DataFrame:
    """(id, region) of rows (id, dims...): region 0, 1, ... by least core id; noise is left out.

    In up to three dimensions rows meet in cells so small that the rows of one are all
    within eps of each other: a cell of min_samples rows is all core and one region, and no
    pairs of its rows are made. Cells are joined where two of their parts, with core rows
    in both, lie within eps as a whole; rows are compared only between parts that may be
    close, of cells that this leaves in different regions, and only when these parts have
    been halved until few pairs of rows are left open. The answer is exact.
    """
    if len(dims) > 3:
        return _dbscan_pairs(points, dims, eps, min_samples)
    d = len(dims)
    side = eps / math.sqrt(d) * (1 - SLACK)
    part, reach = side / CELL_PARTS, math.ceil(eps / side)
    place = lambda width: F.array(*[F.floor(F.col(c) / F.lit(width)) for c in dims])
    own = points.select("id", *dims, place(side).alias("cell"), place(part).alias("part"))
    sized = materialise(own.join(own.groupBy("cell").agg(F.count("*").alias("n")), "cell"), "dbscan-cells")
    steps = F.array(*[F.array(*[F.lit(s - reach) for s in step]) for step in np.ndindex(*[2 * reach + 1] * d)])

    def met(some: DataFrame, others: DataFrame) -> DataFrame:
        """Rows of some beside those of others, under names with o_, in cells that eps may reach."""
        around = some.withColumn("step", F.explode(steps)).withColumn("at", F.zip_with("cell", "step", lambda c, x: c + x)).drop("step")
        return around.join(others.select(*[F.col(c).alias(f"o_{c}") for c in others.columns]), F.col("at") == F.col("o_cell"))

    close = F.sqrt(sum(((F.col(c) - F.col(f"o_{c}")) * (F.col(c) - F.col(f"o_{c}")) for c in dims), F.lit(0.0))) <= eps
    sparse = sized.where(F.col("n") < min_samples).select("id", *dims, "cell", "part")
    counted = met(sparse, sized.select("id", *dims, "cell")).where(close).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("id")
    core = materialise(sized.where(F.col("n") >= min_samples).select("id", *dims, "cell", "part").unionAll(sparse.join(counted, "id").select("id", *dims, "cell", "part")), "dbscan-core")

    least = core.groupBy("cell").agg(F.min("id").alias("vertex"))
    parts = materialise(core.select("cell", "part").distinct().join(least, "cell"), "dbscan-parts")
    span = lambda more: F.aggregate(F.zip_with("part", "o_part", lambda x, y: F.greatest(F.abs(x - y) + more, F.lit(0)).cast("double")), F.lit(0.0), lambda t, x: t + x * x)
    sure, maybe = span(1) <= (eps * (1 - SLACK) / part) ** 2, span(-1) <= (eps * (1 + SLACK) / part) ** 2
    beside = met(parts, parts).where(F.col("vertex") < F.col("o_vertex"))
    found = connected_components(beside.where(sure).select("vertex", "o_vertex").distinct(), "vertex", "o_vertex")
    named = least.join(found, "vertex", "left").select("cell", F.coalesce("component", "vertex").alias("component"))
    left, right = named.withColumnRenamed("cell", "l_cell"), named.select(F.col("cell").alias("r_cell"), F.col("component").alias("o_component"))
    apart = beside.where(maybe & ~sure).join(left, F.col("cell") == F.col("l_cell")).join(right, F.col("o_cell") == F.col("r_cell")).where("component <> o_component")
    apart = materialise(apart.select("cell", "part", "o_cell", "o_part", "component", "o_component"), "dbscan-apart")
    more = materialise(_linked_apart(core.join(apart.select("cell").unionAll(apart.select("o_cell")).distinct(), "cell", "left_semi"), apart, dims, part, eps), "dbscan-more")
    if more.take(1):
        joined = connected_components(more, "component", "o_component").select(F.col("vertex").alias("v"), F.col("component").alias("whole"))
        named = named.join(joined, F.col("component") == F.col("v"), "left").select("cell", F.coalesce("whole", "component").alias("component"))

    region = with_rank(named.select("component").distinct(), [F.col("component")], "region")
    inside = materialise(core.join(named.join(region, "component").select("cell", "region"), "cell").select("id", *dims, "cell", "region"), "dbscan-regions")
    border = met(sparse.join(inside.select("id"), "id", "left_anti").select("id", *dims, "cell"), inside).where(close).groupBy("id").agg(F.min("o_region").alias("region"))
    return inside.select("id", "region").unionAll(border)


def _linked_apart(core: DataFrame, apart: DataFrame, dims: list[str], width: float, eps: float) -> DataFrame:
    """(component, o_component) of pairs of parts of a width of which some rows lie within eps of each other.

    Rows of a part are a box. Boxes that lie within eps as a whole link, those farther apart
    go, the others are halved in every dimension, but where their components are linked.
    """
    rows = core.select(F.concat("cell", "part").alias("box"), *dims).distinct()
    pairs = apart.select(F.concat("cell", "part").alias("box"), F.concat("o_cell", "o_part").alias("o_box"), "component", "o_component")
    other = lambda df: df.select(*[F.col(c).alias(f"o_{c}") for c in df.columns])
    square = lambda of: sum((of(c) * of(c) for c in dims), F.lit(0.0))
    least = square(lambda c: F.greatest(F.col(f"a_{c}") - F.col(f"o_b_{c}"), F.col(f"o_a_{c}") - F.col(f"b_{c}"), F.lit(0.0)))
    most = square(lambda c: F.greatest(F.col(f"b_{c}") - F.col(f"o_a_{c}"), F.col(f"o_b_{c}") - F.col(f"a_{c}")))
    links = []
    for level in range(1, HALVINGS + 1):
        ends = [e for c in dims for e in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"))]
        boxes = rows.groupBy("box").agg(F.count("*").alias("n"), *ends)
        met = pairs.join(boxes, "box").join(other(boxes), "o_box").where(least <= (eps * (1 + SLACK)) ** 2)
        met = materialise(met.select("box", "o_box", "component", "o_component", (F.col("n").cast("double") * F.col("o_n")).alias("pairs"), (most <= (eps * (1 - SLACK)) ** 2).alias("sure")), "dbscan-boxes")
        links.append(met.where("sure").select("component", "o_component").distinct())
        both = links[-1].unionAll(links[-1].select(F.col("o_component").alias("component"), F.col("component").alias("o_component"))).distinct()
        pairs = met.where(~F.col("sure")).join(both, ["component", "o_component"], "left_anti")
        n, left = pairs.agg(F.count("*"), F.sum("pairs")).first()
        if not n or left <= max(FEW_PAIRS, 2 * n):
            break
        half = F.array(*[F.floor(F.col(c) / F.lit(width / 2**level)) for c in dims])
        open_ = pairs.select("box").unionAll(pairs.select(F.col("o_box").alias("box"))).distinct()
        rows = materialise(rows.join(open_, "box", "left_semi").select(F.col("box").alias("whole"), F.concat("box", half).alias("box"), *dims), "dbscan-rows")
        parts, rows = rows.select("whole", "box").distinct(), rows.drop("whole")
        pairs = pairs.select(F.col("box").alias("whole"), F.col("o_box").alias("o_whole"), "component", "o_component").join(parts, "whole").join(other(parts), "o_whole").select("box", "o_box", "component", "o_component")
    close = F.sqrt(square(lambda c: F.col(c) - F.col(f"o_{c}"))) <= eps
    links.append(pairs.join(rows, "box").join(other(rows), "o_box").where(close).select("component", "o_component"))
    out = links[0]
    for more in links[1:]:
        out = out.unionAll(more)
    return out.distinct()


def _dbscan_pairs(points: DataFrame, dims: list[str], eps: float, min_samples: int) -> DataFrame:
    """dbscan() over more dimensions: all pairs within eps are made.

    Rows meet in cells of width eps of the first three dimensions: whoever is within eps
    lies in a neighbouring cell.
    """
    grid = dims[:3]
    cell = [F.floor(F.col(c) / eps) for c in grid]
    own = points.select("id", *dims, F.array(*cell).alias("cell"))
    steps = F.array(*[F.array(*[F.lit(s) for s in step]) for step in np.ndindex(*[3] * len(grid))])
    around = own.withColumn("step", F.explode(steps)).select("id", *dims, F.zip_with("cell", "step", lambda c, s: c + s - 1).alias("cell"))
    other = own.select(F.col("id").alias("o_id"), *[F.col(c).alias(f"o_{c}") for c in dims], F.col("cell").alias("o_cell"))
    apart = sum(((F.col(c) - F.col(f"o_{c}")) * (F.col(c) - F.col(f"o_{c}")) for c in dims), F.lit(0.0))
    near = materialise(around.join(other, F.col("cell") == F.col("o_cell")).where(F.sqrt(apart) <= eps).select("id", "o_id"), "dbscan")
    core = near.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("id")
    between = near.join(core, "id").join(core.select(F.col("id").alias("o_id")), "o_id")
    linked = connected_components(between, "id", "o_id").select(F.col("vertex").alias("id"), "component")
    core = core.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    region = with_rank(core.select("component").distinct(), [F.col("component")], "region")
    core = core.join(region, "component").select("id", "region")
    border = near.join(core.select(F.col("id").alias("o_id"), "region"), "o_id").groupBy("id").agg(F.min("region").alias("region"))
    return core.unionAll(border.join(core.select("id"), "id", "left_anti"))


class DensityEstimate(Analyzer):
    id = "coverage.density"
    capability = "coverage.density"
    provides = ("coverage.density",)

    def __init__(self, df: DataFrame, id_col: str, columns=None, method="kde", bandwidth=None, kernel="gaussian", n_components=None, max_components=8, random_state=0, sample_for_fit=None):
        require_column(df, id_col, "id_col")
        if columns is None:
            columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != id_col]
        columns = list(columns)
        for c in columns:
            require_column(df, c, "density column")
            if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
                raise ValueError(f"density column {c!r} isn't numeric")
        if method not in ("kde", "gmm"):
            raise ValueError(f"method must be 'kde' or 'gmm', not {method!r}")
        if kernel not in KERNELS:
            raise ValueError(f"kernel must be one of {KERNELS}")
        if not columns:
            raise ValueError("no numeric columns")
        holes = df.agg(*[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        bad = [c for c, m in zip(columns, holes) if m]
        if bad:
            raise ValueError(f"missing values in {bad}")
        self.df, self.id_col, self.columns, self.method, self.kernel = df, id_col, columns, method, kernel
        self.bandwidth, self.n_components, self.max_components, self.random_state, self.sample_for_fit = bandwidth, n_components, max_components, random_state, sample_for_fit
        self._model = None
        self._moments: DataFrame | None = None
        self._blocks: DataFrame | None = None
        self._density: DataFrame | None = None
        self._counted: DataFrame | None = None
        self._regions: dict = {}
        self._quantiles: dict[float, float] = {}

    # fitting

    def _fit(self):
        if self._model is not None:
            return self._model
        if self.method == "kde" and self.sample_for_fit is None:
            self._model = self._fit_whole()
            return self._model
        values = self.df.select(*[number(self.df, c).alias(f"x{i}") for i, c in enumerate(self.columns)], col(self.id_col).alias("id"))
        # a share of the hashes that holds the sample comes to the driver, however many partitions there are
        most, order = self.sample_for_fit or MIXTURE_SAMPLE, F.xxhash64(F.lit(self.random_state), "id")
        limit = int(min(1.0, (1.2 * most + 1000) / max(values.count(), 1)) * (1 << 40))
        few = values.withColumn("order", order).where(F.pmod("order", F.lit(1 << 40)) < limit).drop("id").toPandas()
        rows = few.sort_values(["order", *few.columns[:-1]])[:most].drop(columns="order").to_numpy(dtype=float)
        if not len(rows):
            raise ValueError("no rows to fit")
        mean, std = rows.mean(axis=0), rows.std(axis=0)
        std[std == 0] = 1.0
        z = (rows - mean) / std
        self.mean, self.std, self.bic = mean, std, {}
        if self.method == "kde":
            h = self.bandwidth or len(z) ** (-1 / (len(self.columns) + 4))
            kernel = self.kernel
            self._model = lambda x: kde_log_density((x - mean) / std, z, h, kernel)
        else:
            weights, means, covariances = self._fit_gmm(z)
            self._model = lambda x: gmm_log_density((x - mean) / std, weights, means, covariances)
        return self._model

    def _fit_whole(self) -> DataFrame:
        """Blocks (z) of all rows' z-scores, or their distinct values with numbers (w); sets mean, deviation, number and bandwidth."""
        d = len(self.columns)
        values = self.df.select(*[number(self.df, c).alias(f"x{i}") for i, c in enumerate(self.columns)])
        sums = values.agg(F.count("*"), *[F.avg(f"x{i}") for i in range(d)], *[F.stddev_pop(f"x{i}") for i in range(d)]).first()
        if not sums[0]:
            raise ValueError("no rows to fit")
        mean, std = np.array(sums[1 : d + 1], dtype=float), np.array(sums[d + 1 :], dtype=float)
        std[std == 0] = 1.0
        self.mean, self.std, self.bic, self._n = mean, std, {}, sums[0]
        self._h = self.bandwidth or self._n ** (-1 / (d + 4))
        if self.kernel == "gaussian" and d <= 2:
            # equal rows are one of their number
            counted = values.groupBy(*values.columns).agg(F.count("*").cast("double").alias("w"))
            z, cells = self._cells(values.columns)
            named = [c.alias(f"c{i}") for i, c in enumerate(cells)] + [c.alias(f"z{i}") for i, c in enumerate(z)]
            return materialise(counted.select(*named, "w", *values.columns), "density-values")

        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, BLOCK):
                    x = np.column_stack([batch.column(i).slice(a, BLOCK).to_numpy(zero_copy_only=False) for i in range(d)])
                    yield pa.RecordBatch.from_arrays([pa.array([((x - mean) / std).tobytes()], pa.binary())], names=["z"])

        return materialise(values.mapInArrow(run, "z binary"), "density-blocks")

    def _fit_gmm(self, z):
        """The mixture of least BIC, of 1 to max_components parts (or n_components); the least number wins ties."""
        from pyspark.ml.clustering import GaussianMixture
        from pyspark.ml.functions import array_to_vector

        spark, (n, d) = self.df.sparkSession, z.shape
        data = spark.createDataFrame([(r,) for r in z.tolist()], "a array<double>").select(array_to_vector("a").alias("features"))
        data = data.repartition(max(1, n // 10_000)).cache()  # bounded by sample_for_fit, and read once an iteration
        best = None
        for k in [self.n_components] if self.n_components else range(1, max(1, min(self.max_components, n - 1)) + 1):
            if k == 1:
                w, m, c = [1.0], [z.mean(axis=0)], [np.cov(z.T, bias=True).reshape(d, d)]
            else:
                fitted = GaussianMixture(k=k, seed=self.random_state + 1, maxIter=100, tol=1e-4).fit(data)
                parts = fitted.gaussiansDF.collect()
                w, m, c = fitted.weights, [np.array(p["mean"].toArray()) for p in parts], [p["cov"].toArray() for p in parts]
            likelihood = float(gmm_log_density(z, w, m, c).sum())
            self.bic[k] = -2 * likelihood + math.log(n) * (k * d + k * d * (d + 1) / 2 + k - 1)
            if best is None or self.bic[k] < best[0]:
                best = (self.bic[k], w, m, c)
        data.unpersist()
        return best[1:]

    # scoring

    def _scored(self, df: DataFrame, kept: str) -> DataFrame:
        """(kept columns, x0.., log_density) of rows that have x0.. as doubles."""
        model, d = self._fit(), len(self.columns)
        names = [*df.columns, "log_density"]
        if isinstance(model, DataFrame):
            return self._scored_cells(df, model) if self.kernel == "gaussian" and d <= 2 else self._scored_whole(df, model)

        def run(batches):
            for batch in batches:
                x = np.column_stack([batch.column(batch.num_columns - d + i).to_numpy(zero_copy_only=False) for i in range(d)]) if batch.num_rows else np.zeros((0, d))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model(x), pa.float64())], names=names)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInArrow(run, f"{fields}, log_density double")

    def _scored_whole(self, df: DataFrame, blocks: DataFrame) -> DataFrame:
        """_scored() against all rows: blocks of points meet every block of the table, then their sums are added."""
        spark, d = df.sparkSession, len(self.columns)
        mean, std, h, kernel = self.mean, self.std, self._h, self.kernel

        def pack(batches):
            at = TaskContext.get().partitionId() << 32
            for batch in batches:
                for a in range(0, batch.num_rows, POINT_BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([_packed(batch.slice(a, POINT_BLOCK))], pa.binary())], names=["points", "batch"])
                    at += 1

        def part(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    points = _unpacked(row["batch"])
                    x, z = _floats(points, points.num_columns - d, d), np.frombuffer(row["z"]).reshape(-1, d)
                    e = kde_log_density((x - mean) / std, z, h, kernel) + math.log(len(z))
                    yield pa.RecordBatch.from_arrays([pa.array([row["points"]], pa.int64()), pa.array([e.tobytes()], pa.binary())], names=["points", "e"])

        packed = materialise(df.mapInArrow(pack, "points long, batch binary"), "density-points")
        dealt = packed.repartition(spark.sparkContext.defaultParallelism, "points").crossJoin(blocks)
        parts = dealt.select("points", "batch", "z").mapInArrow(part, "points long, e binary").groupBy("points").agg(F.sort_array(F.collect_list("e")).alias("parts"))
        return self._added(df, packed, parts)

    def _cells(self, columns) -> tuple[list, list]:
        """z-scores of the columns, and their kernel cells."""
        z = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(columns, self.mean, self.std)]
        end = F.lit(float(1 << 40))
        return z, [F.floor(F.greatest(-end, F.least(end, F.coalesce(x / F.lit(self._h * SIDE), F.lit(0.0))))).cast("long") for x in z]

    def _scored_cells(self, df: DataFrame, values: DataFrame) -> DataFrame:
        """_scored() with Gaussian kernels over one or two columns, by cells.

        What is lost, by rows out of reach and by the expansions' ends, is under exp(-LOST)
        of one kernel's height; points where all kernels make less than half of one meet
        the rows themselves.
        """
        d, h, n, mean, std = len(self.columns), self._h, self._n, self.mean, self.std
        reach = math.ceil(math.sqrt(2 * (math.log(n) + LOST)) / SIDE) + 1
        cells, names = [f"c{i}" for i in range(d)], [*df.columns, "log_density"]
        less = math.log(n) + d * math.log(h) + _log_norm("gaussian", d)
        listed = ", ".join(f"{c} long" for c in cells)

        def gather(batches):
            def out(sums):
                keys = np.array(list(sums)).reshape(-1, d)
                return pa.RecordBatch.from_arrays([*[pa.array(k) for k in keys.T], pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=[*cells, "m"])

            sums: dict = {}
            for batch in batches:
                c, z, w = _floats(batch, 0, d), _floats(batch, d, d), batch.column(2 * d).to_numpy(zero_copy_only=False)
                v = z / h - (c + 0.5) * SIDE
                for a, b in _runs(c, BLOCK):
                    key = tuple(c[a].tolist())
                    sums[key] = sums.get(key, 0.0) + cell_moments(v[a:b], w[a:b])
                if len(sums) >= HELD:
                    yield out(sums)
                    sums = {}
            if sums:
                yield out(sums)

        if self._moments is None:
            own = values.select(*cells, *[f"z{i}" for i in range(d)], "w")
            self._moments = materialise(own.repartition(*cells).sortWithinPartitions(*cells).mapInArrow(gather, f"{listed}, m binary"), "density-moments")

        def pack(batches):
            for batch in batches:
                c = _floats(batch, batch.num_columns - d, d)
                own = batch.select(batch.schema.names[:-d])
                at = list(_runs(c, BLOCK))
                yield pa.RecordBatch.from_arrays([*[pa.array([int(c[a, i]) for a, _ in at], pa.int64()) for i in range(d)], pa.array([_packed(own.slice(a, b - a)) for a, b in at], pa.binary())], names=[*cells, "batch"])

        place = [c.alias(f"__c{i}") for i, c in enumerate(self._cells(df.columns[-d:])[1])]
        placed = df.select("*", *place)
        by = [F.col(f"__c{i}") for i in range(d)]
        dealt = placed.repartitionByRange(*by, F.xxhash64(*placed.columns)).sortWithinPartitions(*by)
        blocks = materialise(dealt.mapInArrow(pack, f"{listed}, batch binary"), "density-points")

        tile = F.array(*[F.floor(F.col(c) / TILE) for c in cells]).alias("tile")
        wanted = blocks.select(*cells).distinct().select(tile, *cells)
        sent = self._moments
        for i, c in enumerate(cells):
            sent = sent.withColumn(f"t{i}", F.explode(F.sequence(F.floor((F.col(c) - reach) / TILE), F.floor((F.col(c) + reach) / TILE))))
        sent = sent.select(F.array(*[f"t{i}" for i in range(d)]).alias("tile"), *cells, "m")

        def move(there, here):
            none = not (there.num_rows and here.num_rows)
            want, have = (np.column_stack([t.column(c).to_numpy() for c in cells]) for t in (here, there))
            got = [] if none else tile_coefficients(have, np.array([np.frombuffer(m.as_py()) for m in there.column("m")]), want, reach)
            want = want[: len(got)]
            return pa.table([*[pa.array(k) for k in want.T], pa.array([x.tobytes() for x in got], pa.binary())], names=[*cells, "m"])

        local = sent.groupBy("tile").cogroup(wanted.groupBy("tile")).applyInArrow(move, f"{listed}, m binary")

        def evaluate(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    points = _unpacked(row["batch"])
                    v = (_floats(points, points.num_columns - d, d) - mean) / std / h - (np.array([row[c] for c in cells]) + 0.5) * SIDE
                    with np.errstate(all="ignore"):
                        s = cell_sums(v, np.frombuffer(row["m"])) if row["m"] else np.zeros(len(v))
                        sure = s >= 0.5
                        yield pa.RecordBatch.from_arrays([*points.columns, pa.array(np.log(np.where(sure, s, 1.0)) - less, pa.float64(), mask=~sure)], names=names)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        scored = materialise(blocks.join(local, cells, "left").select(*cells, "batch", "m").mapInArrow(evaluate, f"{fields}, log_density double"), "density-scored")
        discard(blocks)
        far = scored.where(F.col("log_density").isNull()).drop("log_density")
        if not far.take(1):
            return scored
        return scored.where(F.col("log_density").isNotNull()).unionAll(self._scored_far(far, values))

    def _scored_far(self, df: DataFrame, values: DataFrame) -> DataFrame:
        """_scored() of points far from all rows: each block of points meets the blocks of rows that may count beside its nearest."""
        d, h, n, mean, std = len(self.columns), self._h, self._n, self.mean, self.std
        ends = [f"{e}{i}" for i in range(d) for e in ("a", "b")]
        boxed = ", ".join(f"{e} double" for e in ends)

        def box(z):
            return [x for i in range(d) for x in (float(np.fmin.reduce(z[:, i])), float(np.fmax.reduce(z[:, i])))]

        def rows(batches):
            at = TaskContext.get().partitionId() << 32
            for batch in batches:
                for a, b in _runs(_floats(batch, 0, d), BLOCK):
                    z, w = _floats(batch, d, d)[a:b], batch.column(2 * d).to_numpy(zero_copy_only=False)[a:b]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (at, *box(z), z.tobytes(), w.tobytes())], names=["block", *ends, "z", "w"])
                    at += 1

        def dealt(table, cells):
            near = table.select(*[F.floor(c / NEAR).alias(f"__c{i}") for i, c in enumerate(cells)], *table.columns)
            by = [F.col(f"__c{i}") for i in range(d)]
            return near.repartitionByRange(*by, F.xxhash64(*near.columns)).sortWithinPartitions(*by)

        if self._blocks is None:
            self._blocks = materialise(dealt(values.select(*[f"z{i}" for i in range(d)], "w"), [F.floor(F.col(f"z{i}") / F.lit(h * SIDE)) for i in range(d)]).mapInArrow(rows, f"block long, {boxed}, z binary, w binary"), "density-blocks")

        def pack(batches):
            at = TaskContext.get().partitionId() << 32
            for batch in batches:
                for a, b in _runs(_floats(batch, 0, d), FEW_POINTS):
                    own = batch.slice(a, b - a).select(batch.schema.names[d:])
                    z = (_floats(own, own.num_columns - d, d) - mean) / std
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (at, *box(z), _packed(own))], names=["points", *[f"p_{e}" for e in ends], "batch"])
                    at += 1

        points = materialise(dealt(df, self._cells(df.columns[-d:])[1]).mapInArrow(pack, f"points long, {', '.join(f'p_{e} double' for e in ends)}, batch binary"), "density-points")
        least = lambda i: F.greatest(F.col(f"a{i}") - F.col(f"p_b{i}"), F.col(f"p_a{i}") - F.col(f"b{i}"), F.lit(0.0))
        most = lambda i: F.greatest(F.col(f"b{i}") - F.col(f"p_a{i}"), F.col(f"p_b{i}") - F.col(f"a{i}"))
        square = lambda of: sum((of(i) * of(i) for i in range(d)), F.lit(0.0))
        met = materialise(points.drop("batch").crossJoin(self._blocks.select("block", *ends)).select("points", "block", square(least).alias("least"), square(most).alias("most")), "density-met")
        nearest = met.groupBy("points").agg(F.min("most").alias("nearest"))
        met = met.join(nearest, "points").where(F.col("least") <= F.col("nearest") * (1 + SLACK) + F.lit(2 * h * h * (math.log(n) + LOST))).select("points", "block")

        def part(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    own, w = _unpacked(row["batch"]), np.frombuffer(row["w"])
                    x = (_floats(own, own.num_columns - d, d) - mean) / std
                    e = kde_log_density(x, np.frombuffer(row["z"]).reshape(-1, d), h, "gaussian", w) + math.log(w.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([row["points"]], pa.int64()), pa.array([e.tobytes()], pa.binary())], names=["points", "e"])

        parts = met.join(points.select("points", "batch"), "points").join(self._blocks.select("block", "z", "w"), "block").select("points", "batch", "z", "w")
        parts = parts.mapInArrow(part, "points long, e binary").groupBy("points").agg(F.sort_array(F.collect_list("e")).alias("parts"))
        return self._added(df, points, parts)

    def _added(self, df: DataFrame, packed: DataFrame, parts: DataFrame) -> DataFrame:
        """Rows of packed blocks, with the sums of their parts."""
        n, names = self._n, [*df.columns, "log_density"]

        def add(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    points = _unpacked(row["batch"])
                    e = np.logaddexp.reduce([np.frombuffer(x) for x in row["parts"]], axis=0) - math.log(n)
                    yield pa.RecordBatch.from_arrays([*points.columns, pa.array(e, pa.float64())], names=names)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return packed.join(parts, "points").select("batch", "parts").mapInArrow(add, f"{fields}, log_density double")

    def score(self, points: DataFrame) -> DataFrame:
        """points, with the log density at each; they need the fitted columns."""
        for c in self.columns:
            require_column(points, c, "density column")
        made = points.select(*points.columns, *[number(points, c).alias(f"__x{i}") for i, c in enumerate(self.columns)])
        return self._scored(made, "").drop(*[f"__x{i}" for i in range(len(self.columns))])

    def row_density(self) -> DataFrame:
        """id, log_density of the table's own rows; computed once."""
        if self._density is None:
            own = self.df.select(col(self.id_col).alias("id"), *[number(self.df, c).alias(f"x{i}") for i, c in enumerate(self.columns)])
            self._density = materialise(self._scored(own, "id"), "density")
        return self._density.select(F.col("id").alias(self.id_col), "log_density")

    def _range(self, c: str):
        return self.df.agg(F.min(number(self.df, c)), F.max(number(self.df, c))).first()

    def _grid_points(self, at: dict[int, tuple], resolution: int) -> DataFrame:
        """Rows (i.., x0.., log_density): a grid over the dimensions ``at``, others at the table's mean."""
        means = self.df.agg(*[F.avg(number(self.df, c)) for c in self.columns]).first()
        spark, points = self.df.sparkSession, None
        for axis, (name, low, high) in at.items():
            line = spark.range(resolution).select(F.col("id").cast("int").alias(f"i{name}"), (F.lit(low) + F.col("id") * F.lit((high - low) / max(resolution - 1, 1))).alias(f"x{axis}"))
            points = line if points is None else points.join(line)
        return self._scored(points.select(*[f"i{name}" for name, _, _ in at.values()], *[F.col(f"x{k}") if k in at else F.lit(means[k]).alias(f"x{k}") for k in range(len(self.columns))]), "")

    def density_grid(self, dims: tuple[str, str], resolution: int = 100, padding: float = 0.05) -> DataFrame:
        """i, j, x, y, log_density over the padded range of two fitted columns."""
        for c in dims:
            if c not in self.columns:
                raise ValueError(f"{c!r} wasn't fitted")
        at = {}
        for name, c in zip("ij", dims):
            low, high = self._range(c)
            pad = (high - low) * padding
            at[self.columns.index(c)] = (name, low - pad, high + pad)
        x, y = (f"x{self.columns.index(c)}" for c in dims)
        return self._grid_points(at, resolution).select(F.col("ii").alias("i"), F.col("ij").alias("j"), F.col(x).alias("x"), F.col(y).alias("y"), "log_density")

    def density_1d(self, feature: str, resolution: int = 300, padding: float = 0.05) -> DataFrame:
        """i, x, density along one column."""
        if feature not in self.columns:
            raise ValueError(f"{feature!r} wasn't fitted")
        low, high = self._range(feature)
        pad, k = (high - low) * padding, self.columns.index(feature)
        return self._grid_points({k: ("i", low - pad, high + pad)}, resolution).select(F.col("ii").alias("i"), F.col(f"x{k}").alias("x"), F.exp("log_density").alias("density"))

    def density_projection(self, resolution: int = 100, padding: float = 0.05) -> dict:
        """Principal plane of the z-scores: points, explained variance, and a fresh density grid on it."""
        self._fit()
        if len(self.columns) < 2:
            raise ValueError("a projection needs two columns")
        rows = self.df.select(col(self.id_col).alias("id"), *[number(self.df, c).alias(f"x{i}") for i, c in enumerate(self.columns)])
        z = rows.select("id", *[((F.col(f"x{i}") - F.lit(float(self.mean[i]))) / F.lit(float(self.std[i]))).alias(f"z{i}") for i in range(len(self.columns))])
        d = len(self.columns)
        sums = z.agg(*[F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i in range(d) for j in range(d)]).first()
        cov = np.array([[sums[f"c{i}_{j}"] for j in range(d)] for i in range(d)])
        # z-scores have deviation 1 (or 0) but for rounding, which would turn axes that nearly tie
        root = np.where(np.diag(cov) > 0.5, np.sqrt(np.diag(cov)), 1.0)
        values, vectors = np.linalg.eigh(cov / root / root[:, None])
        order = np.argsort(-values)[:2]
        plane = vectors[:, order]
        # an axis points to where its largest part is positive, the first of those that tie
        size = np.abs(plane)
        plane = plane * np.where(plane[(size > size.max(axis=0) * (1 - 1e-9)).argmax(axis=0), [0, 1]] < 0, -1, 1)
        points = z.select("id", *[sum((F.col(f"z{i}") * F.lit(float(plane[i, k])) for i in range(d)), F.lit(0.0)).alias(f"pc{k + 1}") for k in range(2)])
        on_plane = DensityEstimate(points, "id", ["pc1", "pc2"], sample_for_fit=self.sample_for_fit, random_state=self.random_state)
        return {"points": points, "explained_variance": (values[order] / max(values.sum(), 1e-300)).tolist(), "grid": on_plane.density_grid(("pc1", "pc2"), resolution, padding)}

    # reports

    def _quantile(self, q: float) -> float:
        if q not in self._quantiles:
            self._quantiles[q] = quantiles(self.row_density(), "log_density", [q])[0]
        return self._quantiles[q]

    def _counted_density(self) -> DataFrame:
        """log_density, w: densities, each of w rows. Equal rows are scored once, where their densities aren't known yet."""
        if self._density is None and self._counted is None and self.method == "kde" and self.kernel == "gaussian" and len(self.columns) <= 2 and self.sample_for_fit is None:
            values = self._fit()
            self._counted = self._scored(values.select("w", *[f"x{i}" for i in range(len(self.columns))]), "").select("log_density", F.col("w").cast("long").alias("w"))
        if self._counted is not None:
            return self._counted
        return self.row_density().select("log_density", F.lit(1).cast("long").alias("w"))

    def density_summary(self) -> DataFrame:
        """One row: method, n_rows, n_dims, log_density_min/max/mean/median, low_density_threshold (10 % quantile), pct_rows_low_density."""
        own = self._counted_density()
        low, median = quantiles(own, "log_density", [0.10, 0.5], "w")
        x, w, n = F.col("log_density"), F.col("w"), F.sum("w")
        return own.agg(
            F.lit(self.method).alias("method"), n.alias("n_rows"), F.lit(len(self.columns)).alias("n_dims"),
            F.min(x).alias("log_density_min"), F.max(x).alias("log_density_max"), (F.sum(x * w) / n).alias("log_density_mean"), F.lit(median).alias("log_density_median"),
            F.lit(low).alias("low_density_threshold"), (F.sum(F.when(x < low, w).otherwise(0)) / n).alias("pct_rows_low_density"),
        )

    def low_density_count(self) -> DataFrame:
        """One row: n_rows, and n_low, the rows below the 10 % quantile."""
        own = self._counted_density()
        low = quantiles(own, "log_density", [0.10], "w")[0]
        return own.agg(F.sum("w").alias("n_rows"), F.sum(F.when(F.col("log_density") < low, F.col("w")).otherwise(0)).alias("n_low"))

    def low_density_regions(self, threshold="auto", eps: float | None = None, min_samples: int = 5) -> DataFrame:
        """Clusters of the rows below the threshold ('auto': the 10 % quantile): region_id, n_points, mean_log_density, centroid, radius."""
        return self._region("low", threshold, eps, min_samples)

    def high_density_clusters(self, threshold="auto", eps: float | None = None, min_samples: int = 5) -> DataFrame:
        """Clusters of the rows above the threshold ('auto': the 90 % quantile)."""
        return self._region("high", threshold, eps, min_samples)

    def _region(self, side, threshold, eps, min_samples) -> DataFrame:
        key = (side, threshold, eps, min_samples)
        if key in self._regions:
            return self._regions[key]
        self.row_density()
        limit = self._quantile(0.10 if side == "low" else 0.90) if threshold == "auto" else float(threshold)
        d = len(self.columns)
        chosen = self._density.where(F.col("log_density") < limit if side == "low" else F.col("log_density") > limit)
        z = chosen.select("id", "log_density", *[((F.col(f"x{i}") - F.lit(float(self.mean[i]))) / F.lit(float(self.std[i]))).alias(f"z{i}") for i in range(d)])
        dims = [f"z{i}" for i in range(d)]
        rows = z.join(dbscan(z.select("id", *dims), dims, eps or 0.5 * math.sqrt(d), min_samples), "id")
        rows = materialise(rows, "regions")
        centre = rows.groupBy("region").agg(F.count("*").alias("n_points"), F.avg("log_density").alias("mean_log_density"), *[F.avg(c).alias(f"m_{c}") for c in dims])
        apart = F.sqrt(sum(((F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in dims), F.lit(0.0)))
        radius = rows.join(centre.select("region", *[f"m_{c}" for c in dims]), "region").groupBy("region").agg(F.max(apart).alias("radius"))
        place = F.create_map(*[x for i, c in enumerate(self.columns) for x in (F.lit(c), F.lit(float(self.mean[i])) + F.lit(float(self.std[i])) * F.col(f"m_z{i}"))])
        out = centre.join(radius, "region").select(F.col("region").alias("region_id"), "n_points", "mean_log_density", place.alias("centroid"), "radius")
        self._regions[key] = out.orderBy(F.desc("n_points"), "region_id")
        return self._regions[key]
