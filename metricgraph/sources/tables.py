"""Domain tables derived from the driver's tables, as DataFrames and as the same in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricgraph.functions.storage import parts_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, features, label) from embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("node_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, coord): the first two components of each embedding."""
    return nodes(spark, sf_dir).select(F.col("node_id").alias("id"), F.slice("features", 1, 2).alias("coord"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, u, v) from customers: account balance and nation, centred and scaled."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("id"), (F.col("c_acctbal").cast("double") / 5000.0 - 0.9).alias("u"), (F.col("c_nationkey").cast("double") / 12.0 - 1.0).alias("v"))


def supplier_edges(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """(src, dst, weight) with src < dst: suppliers that share orders, and how many they share."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("long").alias("s")).filter("l_orderkey is not null")
    parts = parts_for(spark, lines.count())
    sets = lines.repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("s").alias("set"))
    pairs = sets.select(F.explode("set").alias("src"), "set").select("src", F.explode(F.filter("set", lambda x: x > F.col("src"))).alias("dst"))
    # Dealt as they are: hardly any pair repeats inside a partition, so a partial count would only hold memory.
    counted = pairs.repartition(parts, "src", "dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    return counted.filter(F.col("weight") >= least)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("node_id"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, score, label): length of a labelled document and whether it is toxic."""
    d, t = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.select("doc_id", "n_chars").join(t, "doc_id").select(F.col("doc_id").alias("node_id"), F.floor(F.col("n_chars") / 50).cast("double").alias("score"), F.col("toxic").alias("label"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(epoch, decoder, component, value) from events: day, event type, 'value'."""
    e = table(spark, sf_dir, "events")
    return e.select(F.dayofyear("ts").alias("epoch"), F.col("event_type").alias("decoder"), F.lit("value").alias("component"), F.col("value").cast("double").alias("value"))


#: The same tables for the oracles.
SQL = {
    "nodes": "nodes as (select vec_id as node_id, list_transform(embedding, lambda x: x::double) as features, label from embeddings)",
    "points": "points as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y from embeddings)",
    "seeds": "seeds as (select c_custkey::bigint as id, c_acctbal::double / 5000.0 - 0.9 as u, c_nationkey::double / 12.0 - 1.0 as v from customer)",
    "supplier_pairs": "supplier_pairs as (select a.s as src, b.s as dst, count(*)::double as weight from (select distinct l_orderkey as o, l_suppkey::bigint as s from lineitem) a join (select distinct l_orderkey as o, l_suppkey::bigint as s from lineitem) b on a.o = b.o and a.s < b.s group by 1, 2)",
    "scores": "scores as (select d.doc_id as node_id, floor(d.n_chars / 50)::double as score, l.toxic as label from documents d join labels l on d.doc_id = l.doc_id)",
    "history": "history as (select dayofyear(ts)::int as epoch, event_type as decoder, 'value' as component, value::double as value from events)",
}


def with_tables(*names: str) -> str:
    """The head of an oracle over these tables."""
    return "with " + ", ".join(SQL[n] for n in names)
