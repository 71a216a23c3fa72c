"""Distances over field tables, paths by pointer doubling, lengths against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricgraph.functions import storage
from metricgraph.operators import field, lattice, paths, scoring
from metricgraph.plans.models import DECODER_BODY, DECODER_LV, DECODER_MU

BOX = [(-1.0, 1.0), (-1.0, 1.0)]
METRIC = field.bump_metric()


@pytest.fixture(scope="module")
def ends(spark):
    return spark.createDataFrame([(0, [-0.9, -0.83]), (1, [0.7, 0.66]), (2, [0.05, -0.4])], "id long, coord array<double>")


def test_a_field_table_gives_the_same_distances(spark, ends):
    nodes = lattice.lattice_nodes(spark, BOX, 8)
    table = field.evaluate_field(nodes, METRIC)
    own = ends.join(field.evaluate_field(ends.withColumnRenamed("id", "cell"), METRIC).select(F.col("cell").alias("id"), "g"), "id")
    ours = {(r["i"], r["j"]): r for r in lattice.field_distances(table, own, BOX, 8).collect()}
    theirs = {(r["i"], r["j"]): r for r in lattice.lattice_distances(spark, ends, METRIC, BOX, 8, hops=4).collect()}
    assert len(ours) == 3 and set(ours) == set(theirs)
    for k, r in ours.items():
        assert r["search_cost"] == pytest.approx(theirs[k]["search_cost"]) and r["length"] == pytest.approx(theirs[k]["length"])
    snapped = lattice.field_distances(table, ends, BOX, 8).count()
    assert snapped == 3
    with pytest.raises(ValueError, match="out of bounds"):
        lattice.field_distances(table, spark.createDataFrame([(0, [3.0, 0.0])], "id long, coord array<double>"), BOX, 8)


def test_field_edges_need_no_join(spark):
    nodes = lattice.lattice_nodes(spark, BOX, 6)
    table = field.evaluate_field(nodes, METRIC)
    ours = {(r["src"], r["dst"]): r["weight"] for r in lattice.field_edges(table, BOX, 6).collect()}
    theirs = {(r["src"], r["dst"]): r["weight"] for r in lattice.weigh_edges(lattice.lattice_edges(nodes, 6), nodes, METRIC).collect()}
    assert set(ours) == set(theirs) and all(math.isclose(w, theirs[k]) for k, w in ours.items())
    plan = lattice.field_edges(table, BOX, 6)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {k for k in ours if 24 not in k} == {(r["src"], r["dst"]) for r in lattice.field_edges(table.filter("cell <> 24"), BOX, 6).collect()}


@pytest.mark.parametrize("hops", [1, 4])
def test_paths_by_doubling(spark, hops, monkeypatch):
    """A chain of 70 nodes with chords, and a node apart."""
    pairs = {(i, i + 1): 1.0 + i % 3 for i in range(69)} | {(i, i + 9): 9.5 for i in range(0, 60, 7)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()], "src long, dst long, weight double")
    sources = spark.createDataFrame([(0,), (33,), (99,)], "source long")
    labels = paths.shortest_paths(edges, sources, hops=hops)
    written = []
    monkeypatch.setattr(paths, "stored", lambda df, label: written.append(label) or storage.stored(df, label))
    walked = paths.walk_paths(labels).collect()
    dist = {(r["source"], r["node"]): r["dist"] for r in labels.collect()}
    found = {}
    for r in sorted(walked, key=lambda r: r["seq"]):
        found.setdefault((r["src"], r["dst"]), []).append(r["node"])
    assert set(found) == set(dist) and found[99, 99] == [99]
    for (s, t), nodes in found.items():
        assert nodes[0] == s and nodes[-1] == t
        assert math.isclose(sum(pairs.get((a, b)) or pairs[b, a] for a, b in zip(nodes, nodes[1:], strict=False)), dist[s, t], abs_tol=1e-9)
    longest = max(map(len, found.values())) - 1
    assert written.count("walk") - 1 <= 1 + math.log2(longest)
    some = paths.walk_paths(labels, spark.createDataFrame([(0, 69), (33, 1)], "source long, node long"))
    assert {(r["src"], r["dst"]) for r in some.collect()} == {(0, 69), (33, 1)} and some.filter("src = 0").count() == len(found[0, 69])


def test_lengths_of_paths(spark):
    rng = np.random.default_rng(4)
    at = {i: rng.uniform(-0.3, 0.3, 2) for i in range(6)}
    walks = {(0, 5): [0, 2, 5], (1, 4): [1, 4], (3, 3): [3], (5, 0): [5, 4, 3, 0]}
    rows = spark.createDataFrame([(s, t, k, n) for (s, t), w in walks.items() for k, n in enumerate(w)], "src long, dst long, seq int, node long")
    positions = spark.createDataFrame([(i, p.tolist()) for i, p in at.items()], "node long, coord array<double>")

    def factor(p):
        return 1 + 2000 * math.exp(-(p @ p) / 0.15**2)

    for kind, size in (("geodesic", lambda a, b: math.sqrt((factor(a) + factor(b)) / 2) * math.dist(a, b)), ("euclidean", math.dist), ("unit", lambda a, b: 1.0)):
        got = {(r["src"], r["dst"]): r["length"] for r in paths.measure_paths(rows, positions, METRIC, kind).collect()}
        assert set(got) == set(walks)
        for k, w in walks.items():
            assert got[k] == pytest.approx(sum(size(at[a], at[b]) for a, b in zip(w, w[1:], strict=False)))


def test_rbf_takes_the_place_of_sigma(spark):
    rng = np.random.default_rng(2)
    x, outputs = rng.normal(size=(5, 2)), len(DECODER_MU.w)
    centers = [(k, rng.normal(size=2).tolist(), 0.5 + k, rng.uniform(0.5, 1, outputs).tolist()) for k in range(3)]
    points = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, coord array<double>")
    found = {r["id"]: r["g"] for r in scoring.pullback_field_rbf(points, DECODER_BODY, DECODER_MU, DECODER_LV, spark.createDataFrame(centers, "k int, c array<double>, lambda double, w array<double>")).collect()}
    j_mu, _ = scoring._variational_jacobians(x, DECODER_BODY, DECODER_MU, DECODER_LV)
    for i, p in enumerate(x):
        e = [(lam, p - np.array(c), math.exp(-lam * float((p - np.array(c)) @ (p - np.array(c)))), w) for _, c, lam, w in centers]
        j = np.array([[0.5 * sum(2 * lam * d[a] * w[o] * v for lam, d, v, w in e) / (sum(w[o] * v for _, _, v, w in e) + 1e-6) for a in range(2)] for o in range(outputs)]) + j_mu[i]
        assert np.allclose(found[i], (j.T @ j).ravel())
