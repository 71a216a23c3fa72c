"""Partitions that follow the size of a table."""

from pyspark.sql import functions as F

from metricgraph.functions.storage import parts_for
from metricgraph.operators import laplacian
from metricgraph.plans import graphs
from metricgraph.sources import tables


def test_partitions_follow_the_rows(spark):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts_for(spark, 0) == parts_for(spark, 1) == few and parts_for(spark, 10**8) == 400 and parts_for(spark, few * 10 + 1, 10) == few + 1


def test_laplacian_dealt_into_parts(spark):
    nodes = spark.range(6).select(F.col("id").alias("node_id"))
    one = [(0, 1, 2.0), (1, 2, 1.0), (3, 4, 5.0)]
    edges = spark.createDataFrame(one + [(b, a, w) for a, b, w in one], "src long, dst long, weight double")
    for options in ({}, {"normalize": False, "regularization": 0.5}):
        split = laplacian.laplacian(nodes, edges, parts=7, **options)
        assert split.rdd.getNumPartitions() == 7
        assert sorted(split.collect()) == sorted(laplacian.laplacian(nodes, edges, **options).collect())


def test_supplier_edges_without_a_join(spark, tmp_path):
    rows = [(1, 5), (1, 5), (1, 6), (1, None), (2, 6), (2, 5), (2, 7), (None, 5), (None, 6), (3, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    e = tables.supplier_edges(spark, str(tmp_path))
    assert sorted(map(tuple, e.collect())) == [(5, 6, 2.0), (5, 7, 1.0), (6, 7, 1.0)]
    assert "Join" not in e._jdf.queryExecution().toString()
    both = graphs.edges(spark, str(tmp_path))
    assert sorted(map(tuple, both.collect())) == sorted([(5, 6, 2.0), (5, 7, 1.0), (6, 7, 1.0), (6, 5, 2.0), (7, 5, 1.0), (7, 6, 1.0)])
