"""Queries that write a table with format("matrix") or as a dataset, and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricgraph.functions.storage import shared_folder
from metricgraph.plans.registry import query
from metricgraph.sources import matrices, tables

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: A shipment matrix for each line number: parts folded onto columns, suppliers onto rows; one row more than columns.
FOLDED = "select l_linenumber as graph_id, l_suppkey % 21 as r, l_partkey % 20 as c, sum(l_quantity)::double as value from lineitem group by all"


@query(
    "matrix_file",
    f"with m as (select row_number() over (order by l_orderkey, l_linenumber, {', '.join(MEASURES)}) - 1 as row, [{', '.join(f'{c}::double' for c in MEASURES)}] as v from lineitem) select row, i - 1 as col, v[i] as value from m, unnest(range(1, {len(MEASURES) + 1})) u(i)",
)
def matrix_file(spark: SparkSession, sf: str) -> DataFrame:
    li = tables.table(spark, sf, "lineitem")
    path = shared_folder(spark, "matrix")
    matrices.write_matrix(li.select("l_orderkey", "l_linenumber", *MEASURES, F.array(*(F.col(c).cast("double") for c in MEASURES)).alias("values")), path, ["l_orderkey", "l_linenumber", *MEASURES])
    return matrices.read_matrix(spark, path)[0].select("row", "col", "value")


@query("inferred_matrix", "select row_number() over (order by p_partkey) - 1 as row, p_partkey::double as p_partkey, p_name, p_size::double as p_size, p_retailprice::double as p_retailprice from part")
def inferred_matrix(spark: SparkSession, sf: str) -> DataFrame:
    p = tables.table(spark, sf, "part").select(F.lit("part").alias("one"), F.col("p_partkey").alias(" p_partkey"), F.col("p_name").alias("p_name "), F.col("p_size").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"), F.col("p_partkey").alias("key"))
    path = shared_folder(spark, "table")
    matrices.write_matrices(p, path, "{one}.csv", "one", ["key"])
    return matrices.read_table(spark, f"{path}/part.csv")[0].drop("file")


def _simulations(spark: SparkSession, sf: str) -> str:
    """Folders sim_<line number> with a shipment matrix and the vectors of customers, dealt by nation."""
    path = shared_folder(spark, "simulations")
    li = tables.table(spark, sf, "lineitem")
    cells = li.groupBy(F.col("l_linenumber").alias("graph_id"), (F.col("l_suppkey") % 21).alias("r"), (F.col("l_partkey") % 20).alias("c")).agg(F.sum("l_quantity").cast("double").alias("value"))
    rows = li.select(F.col("l_linenumber").alias("graph_id")).distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(20)))).join(cells, ["graph_id", "r"], "left")
    rows = rows.groupBy("graph_id", "r").agg(F.map_from_entries(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "value")))).alias("held"))
    values = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda c: F.coalesce(F.try_element_at("held", c.cast("long")), F.lit(0.0)))
    matrices.write_matrices(rows.select("graph_id", "r", values.alias("values")), path, "sim_{graph_id}/SMS-Save-OptimalGraph-{graph_id}.csv", "graph_id", ["r"])
    c = tables.table(spark, sf, "customer")
    digits = F.array_join(F.split(F.col("c_custkey").cast("string"), ""), " ")
    agents = c.select((1 + F.col("c_nationkey") % 7).alias("graph_id"), (F.col("c_custkey") % 3).cast("string").alias(" round "), F.concat(F.lit(" a"), (F.col("c_custkey") % 50).cast("string")).alias("agentid "), digits.alias("P"), F.col("c_custkey").alias("key"))
    matrices.write_matrices(agents, path, "sim_{graph_id}/SMS-Save-Vertices-{graph_id}.csv", "graph_id", ["key"])
    return path


@query("simulation_edges", f"select graph_id::bigint as graph_id, r::bigint as src, c::bigint as dst, value as weight from ({FOLDED}) where r < 20 and value <> 0")
def simulation_edges(spark: SparkSession, sf: str) -> DataFrame:
    return matrices.read_simulations(spark, _simulations(spark, sf))[0]


@query(
    "simulation_vectors",
    """with a as (select (1 + c_nationkey % 7)::bigint as graph_id, 'a' || (c_custkey % 50) as agent, c_custkey from customer where c_custkey % 3 = 0 and (1 + c_nationkey % 7) in (select distinct l_linenumber from lineitem)),
    one as (select graph_id, agent, max(c_custkey) as last, min(c_custkey) as first from a group by all)
    select graph_id, agent, last::varchar as digits, row_number() over (partition by graph_id order by first) - 1 as position from one""",
)
def simulation_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = matrices.read_simulations(spark, _simulations(spark, sf))[1]
    return v.select("graph_id", "agent", F.array_join(F.col("p").cast("array<string>"), "").alias("digits"), "position")


@query("dataset_round_trip", "select vec_id as id, round(embedding[1]::double, 6) as x, round(embedding[2]::double, 6) as y, 'embeddings' as manifold, 2::bigint as dims, 0.5::double as noise_std from embeddings")
def dataset_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "dataset")
    matrices.save_dataset(tables.points(spark, sf), path, manifold="embeddings", dims=2, noise_std=0.5)
    points, meta = matrices.load_dataset(spark, path)
    return points.select("id", F.round(F.get("coord", F.lit(0)), 6).alias("x"), F.round(F.get("coord", F.lit(1)), 6).alias("y"), *(F.lit(meta[k]).alias(k) for k in ("manifold", "dims", "noise_std")))
