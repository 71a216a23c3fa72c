"""Matrix files, simulation folders and saved datasets as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricgraph.sources.datasource import registered


def _lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of format("matrix") with their row in the file: the lines of the ranges before are counted by one small job."""
    lines = registered(spark).read.format("matrix").options(path=path, **options).load()
    order = lines.groupBy("file", "part").agg(F.count("*").alias("n"))
    before = order.selectExpr("file", "part", "coalesce(sum(n) over (partition by file order by part rows between unbounded preceding and 1 preceding), 0) as before")
    return lines.join(before, ["file", "part"]).withColumn("row", F.col("before") + F.col("line")).drop("part", "line", "before")


def read_matrix(spark: SparkSession, path: str, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """A numeric CSV without header: (coo(file, row, col, value), rejects(file, row, line)).

    path: a file, a folder of parts of one matrix, or a pattern of files. A line with anything that is no number goes to the
    rejects as a whole. Blank lines count for nothing.
    """
    lines = _lines(spark, path, delimiter=delimiter, layout="matrix")
    coo = lines.filter("reject is null").select("file", "row", F.posexplode("values").alias("col", "value"))
    return coo.withColumn("col", F.col("col").cast("long")), lines.filter("reject is not null").select("file", "row", F.col("reject").alias("line"))


def read_table(spark: SparkSession, path: str, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """A file with a header, or several of one kind: (file, row and its columns, kinds inferred), and rejects(file, row, line)."""
    lines = _lines(spark, path, delimiter=delimiter, layout="table")
    return lines.filter("reject is null").drop("reject"), lines.filter("reject is not null").select("file", "row", F.col("reject").alias("line"))


def write_matrix(rows: DataFrame, path: str, order: list[str], values: str = "values") -> None:
    """rows(*order, values array<double>) as the lines of one matrix, sorted by `order`, a file for each partition."""
    registered(rows.sparkSession)
    rows.orderBy(*order).select(values).write.format("matrix").option("path", path).mode("append").save()


def write_matrices(rows: DataFrame, path: str, files: str, key: str, order: list[str]) -> None:
    """One file for each value of `key`: its rows sorted by `order`, all other columns written; files has {key} in its name."""
    registered(rows.sparkSession)
    dealt = rows.repartition(key).sortWithinPartitions(key, *order).drop(*(c for c in order if c != key))
    dealt.write.format("matrix").option("path", path).option("files", files).mode("append").save()


def matrix_shape(coo: DataFrame) -> DataFrame:
    """(file, rows, cols) of each matrix."""
    return coo.groupBy("file").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def _graph_id() -> Column:
    return F.regexp_extract("file", "sim_(\\d+)", 1).cast("long")


def read_simulations(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Folders sim_<int>: (edges(graph_id, src, dst, weight), vectors(graph_id, agent, p, position)).

    An adjacency is cropped to as many rows as it has columns. Folders of other names hold no simulation.
    """
    coo, _ = read_matrix(spark, f"{root}/sim_*/SMS-Save-OptimalGraph-*.csv")
    coo = coo.withColumn("graph_id", _graph_id()).filter(F.col("graph_id").isNotNull())
    size = coo.groupBy("graph_id").agg((F.max("col") + 1).alias("n"))
    edges = coo.join(size, "graph_id").filter((F.col("row") < F.col("n")) & (F.col("value") != 0))
    edges = edges.select("graph_id", F.col("row").alias("src"), F.col("col").alias("dst"), F.col("value").alias("weight"))
    return edges, read_vectors(spark, f"{root}/sim_*/SMS-Save-Vertices-*.csv")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, agent, p array<int>, position): the digits of P of each agent in round 0.

    Header names may be padded. Of an agent that repeats, the later line's vector and the earlier line's position count.
    """
    raw = registered(spark).read.schema("file string, part int, line long, reject string, round string, agentid string, P string").format("matrix").options(path=path, layout="table").load()
    first = raw.filter("round = '0'").withColumn("graph_id", _graph_id()).withColumn("line", F.struct("part", "line"))
    digits = F.filter(F.split(F.regexp_replace("P", "\\s", ""), ""), lambda x: x != "")
    one = first.groupBy("graph_id", F.trim("agentid").alias("agent")).agg(F.max_by(F.transform(digits, lambda x: x.cast("int")), "line").alias("p"), F.min("line").alias("first"))
    return one.selectExpr("graph_id", "agent", "p", "row_number() over (partition by graph_id order by first) - 1 as position")


def assemble_nodes(features: DataFrame, names: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """nodes(node_id, features[, name][, label]) from coo features(row, col, value), by row position (A5)."""
    out = features.groupBy(F.col("row").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda s: s["value"]).alias("features"))
    for other in (names, labels):
        out = out if other is None else out.join(other, "node_id")
    return out


def save_dataset(points: DataFrame, path: str, **metadata: object) -> None:
    """Points as Parquet and the metadata as a JSON table of one row beside them."""
    points.write.mode("overwrite").parquet(f"{path}/points")
    fields = T.StructType([T.StructField(k, {int: T.LongType(), float: T.DoubleType()}.get(type(v), T.StringType())) for k, v in metadata.items()])
    points.sparkSession.createDataFrame([tuple(metadata.values())], fields).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, object]]:
    """The points and the metadata that save_dataset wrote."""
    return spark.read.parquet(f"{path}/points"), spark.read.json(f"{path}/metadata").first().asDict()
