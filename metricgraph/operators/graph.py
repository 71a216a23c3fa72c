"""Edge tables (A7 to A16) and connected components (B15). Edges are (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricgraph.functions.storage import discard, stored
from metricgraph.operators.distance import all_pairs


def edges_from_matrix(coo: DataFrame) -> DataFrame:
    """Non-zero entries of coo(row, col, value) as edges; negative ones stay, binary ones weigh 1.0."""
    return coo.filter("value <> 0").select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("value").cast("double").alias("weight"))


def is_weighted(edges: DataFrame) -> DataFrame:
    """One row: whether any positive weight differs from 1."""
    return edges.agg(F.coalesce(F.bool_or((F.col("weight") > 0) & (F.col("weight") != 1)), F.lit(False)).alias("is_weighted"))


def _both(edges: DataFrame, *more: str) -> DataFrame:
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", *more)
    return edges.select("src", "dst", "weight", *more).union(flipped)


def symmetrize(edges: DataFrame, combine: str = "sum", order: str | None = None) -> DataFrame:
    """Symmetric edges. "sum" adds both directions of every row, so a self-loop or a twice listed edge doubles.
    "last" keeps the weight of the row with the greatest `order`; of rows with equal order, the greatest weight (A9)."""
    if combine == "sum":
        return _both(edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    if order is None:
        raise ValueError('combine="last" needs an order column')
    return _both(edges, order).groupBy("src", "dst").agg(F.max_by("weight", F.struct(order, "weight")).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges of one direction in both, made in one pass: columns <name>_src and <name>_dst change places with src and dst."""
    ends = [c[:-4] for c in edges.columns if c.endswith("_src")]
    rest = [c for c in edges.columns if c not in ("src", "dst") and not c.endswith(("_src", "_dst"))]

    def way(src: str, dst: str) -> Column:
        return F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), *rest, *(F.col(f"{c}_{o}").alias(f"{c}_{n}") for c in ends for n, o in (("src", src), ("dst", dst))))

    return edges.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("e")).select("e.*")


def at_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """edges with <name>_src and <name>_dst for each of these columns of nodes(node_id, ...): joined, unless edges carry them."""
    missing = [c for c in columns if f"{c}_src" not in edges.columns or f"{c}_dst" not in edges.columns]
    for end in ("src", "dst") if missing else ():
        edges = edges.join(nodes.select(F.col("node_id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in missing)), end)
    return edges


def without_loops(edges: DataFrame) -> DataFrame:
    """Edges between different nodes (A10)."""
    return edges.filter("src <> dst")


def complete_edges(nodes: DataFrame, max_nodes: int = 5_000, force: bool = False) -> DataFrame:
    """Every ordered pair of different nodes (A11). The result has n * (n - 1) rows; more than max_nodes needs force."""
    n = nodes.count()
    if n > max_nodes and not force:
        raise ValueError(f"a complete edge set over {n} nodes has {n * (n - 1)} rows; pass force=True to make it")
    pairs = all_pairs(nodes.select(F.col("node_id").alias("id"), F.lit(None).alias("coord")), force=True)
    ends = F.explode(F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst")), F.struct(F.col("j").alias("src"), F.col("i").alias("dst"))))
    return pairs.select(ends.alias("e")).select("e.src", "e.dst", F.lit(1.0).alias("weight"))


def loop_edges(nodes: DataFrame) -> DataFrame:
    """The identity: one self-loop for each node."""
    return nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(1.0).alias("weight"))


def gather(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(src, dst) with the weight of that edge, 0.0 where there is none."""
    return pairs.join(edges.select("src", "dst", "weight"), ["src", "dst"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def label_last(nodes: DataFrame, k: int) -> DataFrame:
    """nodes with label 1 for the last k by position, node ids being 0 to n - 1."""
    n = nodes.agg(F.count("*").alias("_n"))
    return nodes.crossJoin(F.broadcast(n)).withColumn("label", F.when(F.col("node_id") >= F.col("_n") - k, 1).otherwise(0)).drop("_n")


def edge_counts(edges: DataFrame) -> DataFrame:
    """How often each (src, dst) is listed, as weight: the unweighted adjacency."""
    return edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree): sum of the weights of a node's row, 0.0 for an isolated one."""
    found = edges.groupBy(F.col("src").alias("node_id")).agg(F.sum("weight").alias("degree"))
    return nodes.select("node_id").join(found, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))


def reached(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b): component is the least node that can be reached.

    Large-star and small-star rounds: every node is linked to the least of its neighbours, which shortens all trees at
    once, so long chains need few rounds. Each round is written, so that a lost executor repeats one at most, and the
    round before it is deleted. Links from a node to itself and repeated links are harmless; no links give no rows.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        flipped = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = e.union(flipped) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        linked = both.join(least, "a")
        if large:
            return linked.filter("b > a").selectExpr("b as a", "m as b").filter("a <> b").distinct()
        return linked.selectExpr("b as a", "m as b").union(least.selectExpr("a", "m as b")).filter("a <> b").distinct()

    now = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    before = None
    while True:
        then, now = now, stored(star(star(now, True), False), "links")
        discard(then)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.selectExpr("a as node", "b as component").union(now.selectExpr("b as node", "b as component").distinct())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the least node id that can be reached along edges in either direction."""
    found = reached(edges.selectExpr("src as a", "dst as b")).withColumnRenamed("node", "node_id")
    return nodes.select("node_id").join(found, "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))
