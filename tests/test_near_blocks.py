"""Blocks of points that meet within a radius, against the operators that take edges as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricgraph.operators import evaluate, graph, lattice, losses, scoring

RADIUS = 0.1


@pytest.fixture(scope="module")
def nodes(spark):
    """Dense and sparse places, equal points, a point without neighbours, and two near zero vectors."""
    rng = np.random.default_rng(8)
    at = np.concatenate([rng.random((90, 2)) * 0.5 - 0.3, np.full((5, 2), 0.1), [[5.0, -5.0]]])
    z = rng.normal(0, 0.6, (len(at), 5))
    z[[91, 92]] = 0.0
    rows = [(int(i), [float(v) for v in p], [float(v) for v in w]) for i, p, w in zip(rng.permutation(len(at)) * 3, at, z, strict=True)]
    return spark.createDataFrame(rows, "node_id long, at array<double>, z array<double>").cache()


@pytest.fixture(scope="module")
def pairs(nodes):
    return lattice.radius_edges(nodes.select(F.col("node_id").alias("id"), F.col("at").alias("coord")), RADIUS).cache()


def near(found, want):
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert found[k] == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_no_edge_of_a_radius_graph_is_a_row(nodes, pairs):
    """The same as over edges; the plans above the blocks join nothing but their list."""
    e = graph.both_ways(pairs.withColumnRenamed("dist", "weight"))
    z, x = nodes.select("node_id", "z"), nodes.select("node_id", F.col("z").alias("features"), "at")
    plain, quick = (dict(map(tuple, d.collect())) for d in (evaluate.structural_errors(z, e, repeated=False), evaluate.near_structural_errors(nodes, RADIUS)))
    near(quick, plain)
    plain, quick = ({r[0]: r[1:] for r in d.collect()} for d in (evaluate.assortativity(x.drop("at"), e), evaluate.near_assortativity(x, RADIUS)))
    near(quick, plain)
    assert any(undefined for _, undefined in quick.values())
    assert losses.near_adjacency_bce(nodes, RADIUS, 3.0).first()[0] == pytest.approx(losses.adjacency_bce(z, e, 3.0).first()[0], rel=1e-12)


@pytest.mark.parametrize("size", [2048, 20])
def test_near_pairs_come_once(nodes, pairs, size):
    z = nodes.select("node_id", "z")
    plain, quick = ({(r["src"], r["dst"]): r["logit"] for r in d.collect()} for d in (scoring.edge_probabilities(z, pairs), scoring.near_probabilities(nodes, RADIUS, size)))
    near(quick, plain)
    second = z.select("node_id", F.transform("z", lambda v: 3.0 * v).alias("z"))
    both = nodes.select("node_id", "at", F.col("z").alias("first"), F.transform("z", lambda v: 3.0 * v).alias("second"))
    plain, quick = (sorted(map(tuple, d.collect())) for d in (scoring.interpolated_edges(z, second, pairs, 5), scoring.near_interpolated_edges(both, RADIUS, 5, size=size)))
    assert quick == plain and quick
