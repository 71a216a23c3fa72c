"""Metric fields: bounds, cells, lookup, derivatives and curvature.

A metric is a callable of coordinate columns that returns the rows of a matrix of columns, so it stays in Catalyst. A
field is a table field(cell, coord, g) with row-major g.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricgraph.functions.arrays import Metric, coords, det2, flat, inverse2

Bounds = Sequence[tuple[float, float]]
#: Exact derivatives of a metric: coordinates and one or two axes -> the derived matrix.
Derivatives = Callable[..., list[list[Column]]]


def bump_metric(alpha: float = 2000.0, sigma: float = 0.15) -> Metric:
    """(1 + alpha exp(-r^2 / sigma^2)) I in two dimensions."""

    def metric(p: Sequence[Column]) -> list[list[Column]]:
        f = 1.0 + alpha * F.exp(-(p[0] * p[0] + p[1] * p[1]) / (sigma * sigma))
        return [[f, F.lit(0.0)], [F.lit(0.0), f]]

    return metric


def bump_derivatives(alpha: float = 2000.0, sigma: float = 0.15) -> Derivatives:
    """First and second derivatives of bump_metric in closed form."""

    def derived(p: Sequence[Column], a: int, b: int | None = None) -> list[list[Column]]:
        s = sigma * sigma
        e = alpha * F.exp(-(p[0] * p[0] + p[1] * p[1]) / s)
        f = -2.0 * p[a] / s * e if b is None else e * (4.0 * p[a] * p[b] / (s * s) - (2.0 / s if a == b else 0.0))
        return [[f, F.lit(0.0)], [F.lit(0.0), f]]

    return derived


def flat_metric(p: Sequence[Column]) -> list[list[Column]]:
    return [[F.lit(1.0 if i == j else 0.0) for j in range(len(p))] for i in range(len(p))]


def sphere_metric(p: Sequence[Column]) -> list[list[Column]]:
    """diag(1, sin^2 u): the unit sphere in polar coordinates."""
    return [[F.lit(1.0), F.lit(0.0)], [F.lit(0.0), F.sin(p[0]) * F.sin(p[0])]]


def bounds_of(points: DataFrame, margin: float = 0.1, relative: bool = True) -> DataFrame:
    """(dim, lo, hi) of points(id, coord), widened by a share of each span or by a fixed margin."""
    ends = points.select(F.posexplode("coord").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    pad = (F.col("hi") - F.col("lo")) * margin if relative else F.lit(margin)
    return ends.select("dim", (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))


def collect_bounds(bounds: DataFrame) -> list[tuple[float, float]]:
    """The few rows of bounds as a list, by dimension."""
    return [(r["lo"], r["hi"]) for r in bounds.orderBy("dim").collect()]


def within(p: Sequence[Column], bounds: Bounds, tolerance: float = 1e-9) -> Column:
    """Whether a point lies in the bounds, up to a tolerance."""
    return reduce(lambda a, b: a & b, [(x >= lo - tolerance) & (x <= hi + tolerance) for x, (lo, hi) in zip(p, bounds, strict=True)])


def clamp(p: Sequence[Column], bounds: Bounds) -> list[Column]:
    return [F.greatest(F.lit(lo), F.least(x, F.lit(hi))) for x, (lo, hi) in zip(p, bounds, strict=True)]


def cell_index(p: Sequence[Column], bounds: Bounds, grid: int) -> list[Column]:
    """Lattice index in each dimension: the nearest node, halves to even, kept inside the lattice."""
    return [F.greatest(F.lit(0), F.least(F.bround((x - lo) / ((hi - lo) / grid)).cast("long"), F.lit(grid))) for x, (lo, hi) in zip(p, bounds, strict=True)]


def cell_of(p: Sequence[Column], bounds: Bounds, grid: int) -> Column:
    """Flat row-major cell id (C4)."""
    index = cell_index(p, bounds, grid)
    return reduce(lambda a, b: a * (grid + 1) + b, index)


def evaluate_field(lattice: DataFrame, metric: Metric, dims: int = 2) -> DataFrame:
    """field(cell, coord, g): the metric at every lattice node."""
    return lattice.select("cell", "coord", flat(metric(coords(F.col("coord"), dims))).alias("g"))


def lookup(points: DataFrame, bounds: Bounds, grid: int, field: DataFrame | None = None, metric: Metric | None = None, force: bool = False, dims: int = 2) -> DataFrame:
    """points(id, coord) with g: the field's value at the nearest node, or without a field the metric at the point.

    Points outside the bounds raise an error unless forced; forced points take the nearest cell.
    """
    p = coords(F.col("coord"), dims)
    checked = points
    if not force:
        message = F.concat(F.lit("point out of bounds: "), F.col("coord").cast("string"))
        checked = points.withColumn("coord", F.when(within(p, bounds), F.col("coord")).otherwise(F.raise_error(message).cast("array<double>")))
    if field is None:
        return checked.withColumn("g", flat(metric(p)))
    return checked.withColumn("cell", cell_of(p, bounds, grid)).join(field.select("cell", "g"), "cell", "left").drop("cell")


def field_coverage(lattice: DataFrame, field: DataFrame) -> DataFrame:
    """One row: cells of the lattice, cells that the field fills."""
    missing = lattice.join(field.select("cell"), "cell", "left_anti").agg(F.count("*").alias("m"))
    return lattice.agg(F.count("*").alias("cells")).crossJoin(missing).select("cells", (F.col("cells") - F.col("m")).alias("filled"))


def volume_proxy(g: Sequence[Sequence[Column]]) -> Column:
    """log(1 + max(det G, 0)) for two dimensions, NaN otherwise."""
    return F.log1p(F.greatest(det2(g), F.lit(0.0))) if len(g) == 2 else F.lit(float("nan"))


def derivative(metric: Metric, p: Sequence[Column], axis: int, h: float, bounds: Bounds | None = None) -> list[list[Column]]:
    """Central difference of every component along an axis; the shifted points stay inside the bounds (C17)."""

    def at(step: float) -> list[list[Column]]:
        q = [x + step if i == axis else x for i, x in enumerate(p)]
        return [list(r) for r in metric(clamp(q, bounds) if bounds else q)]

    plus, minus = at(h), at(-h)
    return [[(a - b) / (2.0 * h) for a, b in zip(x, y, strict=True)] for x, y in zip(plus, minus, strict=True)]


def second_derivative(metric: Metric, p: Sequence[Column], i: int, j: int, a: int, b: int, h: float, bounds: Bounds | None = None) -> Column:
    """Second difference of component (i, j) along axes a and b."""

    def at(*steps: tuple[int, float]) -> Column:
        q = list(p)
        for axis, s in steps:
            q[axis] = q[axis] + s
        return metric(clamp(q, bounds) if bounds else q)[i][j]

    if a == b:
        return (at((a, h)) - 2.0 * at() + at((a, -h))) / (h * h)
    return (at((a, h), (b, h)) - at((a, h), (b, -h)) - at((a, -h), (b, h)) + at((a, -h), (b, -h))) / (4.0 * h * h)


def christoffel2(metric: Metric, p: Sequence[Column], h: float = 1e-4, bounds: Bounds | None = None, exact: Derivatives | None = None) -> list[list[list[Column]]]:
    """Christoffel symbols of a metric in two dimensions, upper index first."""
    inv = inverse2(metric(p))
    d = [exact(p, axis) if exact else derivative(metric, p, axis, h, bounds) for axis in range(2)]
    lower = [[[0.5 * (d[i][j][k] + d[j][i][k] - d[k][i][j]) for k in range(2)] for j in range(2)] for i in range(2)]
    return [[[inv[m][0] * lower[i][j][0] + inv[m][1] * lower[i][j][1] for j in range(2)] for i in range(2)] for m in range(2)]


def christoffel(points: DataFrame, dims: int) -> DataFrame:
    """points(id, g, dg) in any dimension with gamma: row-major symbols, upper index first; NaN where G is singular.

    g is D*D and dg holds the D derivatives one after another, both row-major; the inverses are taken batch by batch.
    """

    @F.pandas_udf("array<double>")
    def symbols(g: pd.Series, dg: pd.Series) -> pd.Series:
        if not len(g):
            return pd.Series([], dtype=object)
        m = np.stack(g.to_numpy()).reshape(-1, dims, dims)
        d = np.stack(dg.to_numpy()).reshape(-1, dims, dims, dims)
        lower = 0.5 * (d + d.transpose(0, 2, 1, 3) - d.transpose(0, 2, 3, 1))
        singular = np.abs(np.linalg.det(m)) < 1e-300
        inv = np.linalg.inv(np.where(singular[:, None, None], np.eye(dims), m))
        gamma = np.einsum("nkl,nijl->nkij", inv, lower)
        gamma[singular] = np.nan
        return pd.Series(list(gamma.reshape(len(g), -1)))

    return points.withColumn("gamma", symbols("g", "dg"))


def gaussian_curvature(metric: Metric, p: Sequence[Column], h: float = 1e-3, bounds: Bounds | None = None, exact: Derivatives | None = None) -> Column:
    """Curvature of a metric in two dimensions by the textbook formula: 1 on the unit sphere, 0 on a plane (C20).

    NaN where the determinant is smaller than 1e-12. Differences of step h are off by h^2 and by the rounding of the metric
    over h^2; exact derivatives, where they are known, take their place.
    """
    g = metric(p)
    gamma = christoffel2(metric, p, h, bounds, exact)

    def second(i: int, j: int, a: int, b: int) -> Column:
        return exact(p, a, b)[i][j] if exact else second_derivative(metric, p, i, j, a, b, h, bounds)

    flat_part = second(0, 1, 0, 1) - 0.5 * (second(0, 0, 1, 1) + second(1, 1, 0, 0))
    curved = sum((g[a][b] * (gamma[a][0][1] * gamma[b][0][1] - gamma[a][0][0] * gamma[b][1][1]) for a in range(2) for b in range(2)), F.lit(0.0))
    return F.when(F.abs(det2(g)) < 1e-12, F.lit(float("nan"))).otherwise(F.try_divide(flat_part + curved, det2(g)))


def field_derivatives(field: DataFrame, bounds: Bounds, grid: int) -> DataFrame:
    """field with dx0 and dx1, differences along the lattice axes (one-sided at the border), in two dimensions."""
    step = [(hi - lo) / grid for lo, hi in bounds]
    n = grid + 1
    out = field.withColumns({"i0": F.floor(F.col("cell") / n), "i1": F.col("cell") % n})
    for axis, other in ((0, 1), (1, 0)):
        w = f"over (partition by i{other} order by i{axis})"
        out = out.selectExpr("*", f"lag(g) {w} as before", f"lead(g) {w} as after")
        span = F.when(F.col("before").isNull() | F.col("after").isNull(), step[axis]).otherwise(2.0 * step[axis])
        d = F.transform(F.arrays_zip(F.coalesce("after", "g").alias("a"), F.coalesce("before", "g").alias("b")), lambda s: s["a"] - s["b"])
        out = out.withColumn(f"dx{axis}", F.transform(d, lambda x: x / span)).drop("before", "after")
    return out.drop("i0", "i1")


def mesh(spark, bounds: Bounds, resolution: int) -> DataFrame:  # noqa: ANN001
    """(id, x, y): an evenly spaced mesh over two dimensions, its ends included."""
    (lx, hx), (ly, hy) = bounds
    r = max(1, resolution - 1)
    ids = spark.range(resolution * resolution)
    i, j = F.floor(F.col("id") / resolution), F.col("id") % resolution
    return ids.select("id", (F.lit(lx) + i * ((hx - lx) / r)).alias("x"), (F.lit(ly) + j * ((hy - ly) / r)).alias("y"))


def curvature_change(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, change): relative change of value between two mesh tables, less its mean; NaNs do not count."""
    both = first.select("id", F.col("value").alias("a")).join(second.select("id", F.col("value").alias("b")), "id")
    raw = both.select("id", F.try_divide(F.col("b") - F.col("a"), F.col("a")).alias("r"))
    mean = raw.agg(F.avg(F.nanvl("r", F.lit(None).cast("double"))).alias("m"))
    return raw.crossJoin(F.broadcast(mean)).select("id", (F.col("r") - F.col("m")).alias("change"))
