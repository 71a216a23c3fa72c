"""The library in Spark SQL: functions of metrics and distances, and table functions that stream polylines.

register(spark) makes them temporary functions of the session. A metric is its row-major array of doubles.

    SELECT midpoint_distance(bump_metric(midpoint(a, b), 3, 0.2), a, b) FROM pairs
    SELECT * FROM polyline_length(3, 0.2, TABLE(paths) PARTITION BY path ORDER BY seq)

The table functions see one path after the other, row by row in order: a task holds two points, however long the path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

POINT = "ARRAY<DOUBLE>"
#: Name and parameters, result type, body.
FUNCTIONS = [
    (f"midpoint(a {POINT}, b {POINT})", POINT, "zip_with(a, b, (x, y) -> x + (y - x) * 0.5D)"),
    (f"point_delta(a {POINT}, b {POINT})", POINT, "zip_with(a, b, (x, y) -> y - x)"),
    (f"euclidean_distance(a {POINT}, b {POINT})", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (y - x) * (y - x)), 0D, (s, x) -> s + x))"),
    (f"bump_metric(p {POINT}, alpha DOUBLE, sigma DOUBLE)", POINT, "transform(array(1D, 0D, 0D, 1D), x -> x * (1D + alpha * exp(-(p[0] * p[0] + p[1] * p[1]) / (sigma * sigma))))"),
    (f"quadratic_form(g {POINT}, d {POINT})", "DOUBLE", "aggregate(transform(g, (x, i) -> x * d[cast(i div size(d) as int)] * d[i % size(d)]), 0D, (s, x) -> s + x)"),
    (f"midpoint_distance(g {POINT}, a {POINT}, b {POINT})", "DOUBLE", "sqrt(greatest(quadratic_form(g, point_delta(a, b)), 0D))"),
    (f"endpoint_distance(g0 {POINT}, g1 {POINT}, a {POINT}, b {POINT})", "DOUBLE", "midpoint_distance(zip_with(g0, g1, (x, y) -> (x + y) * 0.5D), a, b)"),
]


def _schema(rows: AnalyzeArgument, *more: tuple[str, T.DataType]) -> AnalyzeResult:
    out = T.StructType([T.StructField("path", rows.dataType["path"].dataType)])
    for name, kind in more:
        out = out.add(name, kind)
    return AnalyzeResult(out)


class PolylineLength:
    """(path, length) of rows(path, seq, coord): each segment by the bump metric at its middle."""

    def __init__(self) -> None:
        self.last, self.path, self.length = None, None, 0.0

    @staticmethod
    def analyze(alpha: AnalyzeArgument, sigma: AnalyzeArgument, rows: AnalyzeArgument) -> AnalyzeResult:
        return _schema(rows, ("length", T.DoubleType()))

    def eval(self, alpha: float, sigma: float, row: Row) -> None:
        if self.last is not None:
            mid = sum(((x + y) / 2) ** 2 for x, y in zip(self.last, row["coord"], strict=True))
            factor = 1.0 + float(alpha) * math.exp(-mid / float(sigma) ** 2)
            self.length += math.sqrt(factor * sum((y - x) ** 2 for x, y in zip(self.last, row["coord"], strict=True)) + 1e-10)
        self.last, self.path = row["coord"], row["path"]

    def terminate(self) -> Iterator[tuple]:
        if self.last is not None:
            yield self.path, self.length


class ResamplePolyline:
    """(path, seq, coord) at `points` even places of rows(path, seq, coord, n), n being the path's number of rows."""

    def __init__(self) -> None:
        self.last, self.row, self.k = None, -1, 0

    @staticmethod
    def analyze(points: AnalyzeArgument, rows: AnalyzeArgument) -> AnalyzeResult:
        return _schema(rows, ("seq", T.IntegerType()), ("coord", T.ArrayType(T.DoubleType())))

    def eval(self, points: int, row: Row) -> Iterator[tuple]:
        last, self.last = self.last, row["coord"]
        self.row += 1
        while self.k < points:
            place = self.k * (row["n"] - 1) / max(1, points - 1)
            low = math.floor(place)
            if low >= row["n"] - 1 and self.row == row["n"] - 1:
                at = self.last
            elif low < self.row:
                at = [(1.0 - (place - low)) * x + (place - low) * y for x, y in zip(last, self.last, strict=True)]
            else:
                return
            yield row["path"], self.k, at
            self.k += 1


def register(spark: SparkSession) -> None:
    """Make all functions known to the session, in place of any of the same name."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("polyline_length", udtf(PolylineLength))
    spark.udtf.register("resample_polyline", udtf(ResamplePolyline))
