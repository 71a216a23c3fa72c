"""Row-local operators over streaming DataFrames.

Lookups, distances and scores are projections or joins with a static table, so the same functions take a stream. No
state is kept and no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metricgraph.functions.arrays import Metric, coords
from metricgraph.operators.distance import Distance, midpoint_distance
from metricgraph.operators.field import Bounds, lookup


def stream_lookup(points: DataFrame, bounds: Bounds, grid: int, field: DataFrame, dims: int = 2) -> DataFrame:
    """A stream of points(id, coord) with the metric of their nearest cell; points outside take the nearest one."""
    return lookup(points, bounds, grid, field, force=True, dims=dims)


def stream_distances(pairs: DataFrame, metric: Metric, distance: Distance = midpoint_distance, dims: int = 2) -> DataFrame:
    """A stream of pairs(i, j, a, b) with dist."""
    return pairs.withColumn("dist", distance(metric, coords(F.col("a"), dims), coords(F.col("b"), dims)))


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files, all that is there now, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
