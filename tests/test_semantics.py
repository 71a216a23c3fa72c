"""Closed forms, properties and edge cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricgraph.functions.arrays import coords
from metricgraph.operators import diffusion, distance, evaluate, field, graph, immersion, laplacian, lattice, losses, neighbors, paths, scoring
from metricgraph.sources import matrices
from metricgraph.streaming import stream_lookup, write_parquet


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs] + [(b, a, float(w)) for a, b, w in pairs], "src long, dst long, weight double")


def nodes_of(spark, n):
    return spark.range(n).select(F.col("id").alias("node_id"))


def test_symmetrize_modes_differ(spark):
    e = spark.createDataFrame([(0, 1, 2.0, 1), (1, 0, 3.0, 2), (2, 2, 5.0, 3)], "src long, dst long, weight double, ord int")
    added = {(r["src"], r["dst"]): r["weight"] for r in graph.symmetrize(e).collect()}
    last = {(r["src"], r["dst"]): r["weight"] for r in graph.symmetrize(e, "last", "ord").collect()}
    assert added == {(0, 1): 5.0, (1, 0): 5.0, (2, 2): 10.0}
    assert last == {(0, 1): 3.0, (1, 0): 3.0, (2, 2): 5.0}
    with pytest.raises(ValueError):
        graph.symmetrize(e, "last")


def test_two_triangles(spark):
    e = edges_of(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1)])
    found = {r["node_id"]: r["component"] for r in graph.components(nodes_of(spark, 7), e).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}
    labels = paths.shortest_paths(e, spark.createDataFrame([(0,)], "source long"))
    assert {r["node"] for r in labels.collect()} == {0, 1, 2}


def test_heat_kernel_of_a_cycle(spark):
    n, t = 8, 0.7
    e = edges_of(spark, [(i, (i + 1) % n, 1) for i in range(n)])
    lap = laplacian.laplacian(nodes_of(spark, n), e, normalize=False)
    k = diffusion.kernel_columns(lap, spark.range(n).select(F.col("id").alias("node")), [t], bound=4.0, degree=20).collect()
    trace = sum(r["value"] for r in k if r["row"] == r["col"])
    assert trace == pytest.approx(sum(math.exp(-t * (2 - 2 * math.cos(2 * math.pi * j / n))) for j in range(n)), abs=1e-8)
    rows = {}
    for r in k:
        rows[r["row"]] = rows.get(r["row"], 0.0) + r["value"]
    assert all(v == pytest.approx(1.0, abs=1e-8) for v in rows.values())


def test_extreme_eigenvalues_of_a_path(spark):
    n = 8
    e = edges_of(spark, [(i, i + 1, 1) for i in range(n - 1)])
    lap = laplacian.laplacian(nodes_of(spark, n), e, normalize=False)
    ones = spark.range(n).select(F.col("id").alias("node"), F.lit(1 / math.sqrt(n)).alias("value"))
    largest, smallest = diffusion.lanczos_extremes(lap, [ones], steps=7)
    assert largest == pytest.approx(2 - 2 * math.cos(math.pi * (n - 1) / n), abs=1e-6)
    assert smallest == pytest.approx(2 - 2 * math.cos(math.pi / n), abs=1e-6)


def test_laplacian_rows_sum_to_zero(spark):
    e = edges_of(spark, [(0, 1, 2), (1, 2, 3)])
    lap = laplacian.laplacian(nodes_of(spark, 4), e, normalize=False)
    assert [r["s"] for r in lap.groupBy("row").agg(F.sum("value").alias("s")).collect()] == [0.0] * 4


def test_sigma_zero_is_an_error(spark):
    pairs = spark.createDataFrame([(0, 1, 0.0), (0, 2, 0.0), (1, 2, 0.0)], "i long, j long, dist double")
    with pytest.raises(Exception, match="sigma is 0"):
        laplacian.affinity(pairs, laplacian.bandwidth(pairs, 3)).collect()


@pytest.mark.parametrize(("metric", "expected"), [(field.flat_metric, 0.0), (field.sphere_metric, 1.0)])
def test_curvature(spark, metric, expected):
    p = spark.createDataFrame([(1.0, 0.3), (0.6, -1.0), (2.2, 2.0)], "x double, y double")
    k = p.select(field.gaussian_curvature(metric, [F.col("x"), F.col("y")]).alias("k")).collect()
    assert all(r["k"] == pytest.approx(expected, abs=1e-4) for r in k)


def test_christoffel_batch_equals_columns(spark):
    from metricgraph.functions.arrays import flat

    p = spark.createDataFrame([(0, [1.0, 0.3]), (1, [0.6, -1.0])], "id long, coord array<double>")
    x = coords(F.col("coord"), 2)
    g = field.christoffel2(field.sphere_metric, x, 1e-5)
    own = p.select("id", F.array(*(g[m][i][j] for m in range(2) for i in range(2) for j in range(2))).alias("c"))
    dg = F.concat(*(flat(field.derivative(field.sphere_metric, x, a, 1e-5)) for a in range(2)))
    batch = field.christoffel(p.select("id", flat(field.sphere_metric(x)).alias("g"), dg.alias("dg")), 2)
    for r in own.join(batch, "id").collect():
        assert np.allclose(r["c"], r["gamma"], atol=1e-9)


def test_cells_round_half_to_even(spark):
    p = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (9.0,), (-3.0,)], "x double")
    got = [r[0] for r in p.select(field.cell_of([F.col("x")], [(0.0, 4.0)], 4)).collect()]
    assert got == [0, 2, 2, 4, 0]


def test_lookup_outside_raises(spark):
    p = spark.createDataFrame([(0, [2.0, 0.0])], "id long, coord array<double>")
    with pytest.raises(Exception, match="out of bounds"):
        field.lookup(p, [(-1, 1), (-1, 1)], 4, metric=field.flat_metric).collect()
    assert field.lookup(p, [(-1, 1), (-1, 1)], 4, metric=field.flat_metric, force=True).count() == 1


def test_flat_distances_agree(spark):
    pairs = spark.createDataFrame([(0, 1, [0.0, 0.0], [0.3, 0.4])], "i long, j long, a array<double>, b array<double>")
    for name in distance.DISTANCES:
        assert distance.pair_distances(pairs, name, field.flat_metric).first()["dist"] == pytest.approx(0.5, abs=1e-6)
    with pytest.raises(ValueError):
        distance.pair_distances(pairs, "nothing", field.flat_metric)


def test_lattice_edge_count(spark):
    grid, n = 6, 7
    nodes = lattice.lattice_nodes(spark, [(0.0, 1.0), (0.0, 1.0)], grid)
    assert lattice.lattice_edges(nodes, grid).count() == 2 * n * (n - 1) + 2 * (n - 1) ** 2
    assert lattice.lattice_edges(nodes, grid, moore=False).count() == 2 * n * (n - 1)


def test_bump_path_is_shorter_than_the_straight_line(spark):
    metric, box = field.bump_metric(), [(-1.5, 1.5), (-1.5, 1.5)]
    ends = spark.createDataFrame([(0, [-1.0, -1.0]), (1, [1.0, 1.0])], "id long, coord array<double>")
    r = lattice.path_report(spark, ends, metric, box, 10).first()
    assert r["euclidean"] == pytest.approx(2 * math.sqrt(2))
    assert r["straight"] == pytest.approx(18.803777, abs=1e-4)
    assert r["euclidean"] <= r["lattice_length"] < r["straight"]


def test_shortcuts_keep_distances(spark):
    e = edges_of(spark, [(i, i + 1, 1 + i % 3) for i in range(12)] + [(0, 5, 20), (3, 9, 2)])
    source = spark.createDataFrame([(0,)], "source long")
    one = {r["node"]: r["dist"] for r in paths.shortest_paths(e, source).collect()}
    four = {r["node"]: r["dist"] for r in paths.shortest_paths(e, source, hops=4).collect()}
    assert one == four
    walked = paths.walk_paths(paths.shortest_paths(e, source)).filter("dst = 9").orderBy("seq").collect()
    assert [r["node"] for r in walked] == [0, 1, 2, 3, 9]


def test_knn_with_equal_points(spark):
    p = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(3)] + [(3, [1.0, 0.0])], "id long, coord array<double>")
    exact = sorted((r["i"], r["j"]) for r in neighbors.knn_exact(p, 2).collect())
    assert exact == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1)]
    assert sorted((r["i"], r["j"]) for r in neighbors.knn_grid(p, 2, 0.1).collect()) == exact


def test_local_maps_recover_a_linear_map(spark):
    rng = np.random.default_rng(0)
    u = rng.normal(size=(30, 2))
    a = np.array([[2.0, 0.5], [-1.0, 3.0]])
    s = spark.createDataFrame([(i, x.tolist(), (a @ x).tolist()) for i, x in enumerate(u)], "id long, u array<double>, z array<double>")
    knn = neighbors.knn_exact(s.select("id", F.col("u").alias("coord")), 6)
    for r in neighbors.local_maps(s, knn).collect():
        assert np.allclose([r["a00"], r["a01"], r["a10"], r["a11"]], a.ravel())


def test_immersions_have_rank_two_and_fixed_draws(spark):
    p = spark.range(40).select("id", (F.col("id") / 10 - 2).alias("u"), (F.sin("id")).alias("v"))
    for name in immersion.IMMERSIONS:
        assert immersion.mean_rank(p, immersion.immersion(name)).first()[0] == 2.0
    a, b = (immersion.immerse(p, immersion.immersion("helicoid", 6, seed=4)).select("coord").collect() for _ in range(2))
    assert a == b


def test_assortativity_of_zero_and_equal_vectors(spark):
    n = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "node_id long, features array<double>")
    e = edges_of(spark, [(0, 1, 1), (2, 3, 1), (0, 2, 1)])
    got = {r["node_id"]: (r["score"], r["undefined"]) for r in evaluate.assortativity(n, e).collect()}
    assert got[0] == (pytest.approx(1.0 - 0.5), 1)
    assert got[2] == (pytest.approx(0.0), 1)
    assert got[4] == (0.0, 0)


def test_scores_with_ties(spark):
    s = spark.createDataFrame([(i, 1.0, i % 2) for i in range(6)], "node_id long, score double, label int")
    assert evaluate.roc_auc(s).first()[0] == pytest.approx(0.5)
    assert {r["x"] for r in evaluate.min_max(s, "score", "x").collect()} == {0.0}
    assert evaluate.average_precision(s).first()[0] == pytest.approx(0.5)
    better = s.withColumn("score", F.exp(F.col("label") * 2.0))
    assert evaluate.roc_auc(better).first()[0] == 1.0


def test_rand_index_of_itself(spark):
    p = spark.createDataFrame([(i % 3, i % 3) for i in range(9)], "a int, b int")
    assert evaluate.adjusted_rand(p).first()[0] == pytest.approx(1.0)


def test_jacobians_equal_differences(spark):
    from metricgraph.operators.scoring import Layer

    net = [Layer("linear", ((1.0, -0.5), (0.3, 0.8), (0.2, 0.1)), (0.1, 0.0, -0.2)), Layer("tanh"), Layer("linear", ((0.5, 1.0, -1.0), (0.2, 0.2, 0.9))), Layer("elu")]
    x = np.array([[0.3, -0.4], [1.0, 2.0]])
    y, j = scoring.forward(x, net, True)
    for axis in range(2):
        d = np.zeros(2)
        d[axis] = 1e-6
        assert np.allclose(j[:, :, axis], (scoring.forward(x + d, net)[0] - scoring.forward(x - d, net)[0]) / 2e-6, atol=1e-6)
    p = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, coord array<double>")
    got = {r["id"]: r["jacobian"] for r in scoring.jacobians(p, net).collect()}
    assert np.allclose(got[1], j[1].ravel())


def test_isolation_forest_finds_the_far_point(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(300)] + [(300, [9.0, 9.0, -9.0])]
    found = evaluate.isolation_forest(spark.createDataFrame(rows, "node_id long, features array<double>"), trees=30, contamination=0.02)
    best = found.orderBy(F.col("score").desc()).first()
    assert best["node_id"] == 300 and best["outlier"] == 1


def test_kl_of_the_prior_is_zero(spark):
    r = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0])], "mu array<double>, logvar array<double>")
    assert losses.kl_divergence(r).first()[0] == pytest.approx(0.0)


def test_matrix_files(spark, tmp_path):
    d = tmp_path / "sim_7"
    d.mkdir()
    (d / "SMS-Save-OptimalGraph-7.csv").write_text("0,1\n1,0\n5,5\n")
    (d / "SMS-Save-Vertices-7.csv").write_text(" round , agentid ,P \n0,a,1 2\n1,a,9 9\n0,b,3 4\n0,a,5 6\n")
    edges, vectors = matrices.read_simulations(spark, str(tmp_path))
    assert sorted((r["graph_id"], r["src"], r["dst"]) for r in edges.collect()) == [(7, 0, 1), (7, 1, 0)]
    assert [(r["agent"], r["p"], r["position"]) for r in vectors.orderBy("position").collect()] == [("a", [5, 6], 0), ("b", [3, 4], 1)]
    (tmp_path / "bad.csv").write_text("1,2\n3,x\n\n4,5\n")
    coo, rejects = matrices.read_matrix(spark, str(tmp_path / "bad.csv"))
    assert coo.count() == 4 and [r["line"] for r in rejects.collect()] == ["3,x"]


def test_dataset_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(0, [1.0, 2.0])], "id long, coord array<double>")
    matrices.save_dataset(p, str(tmp_path / "d"), manifold="helicoid", D=3, seed=1)
    points, meta = matrices.load_dataset(spark, str(tmp_path / "d"))
    assert points.collect() == p.collect() and meta == {"manifold": "helicoid", "D": 3, "seed": 1}


def test_lookup_on_a_stream(spark, tmp_path):
    box = [(-1.0, 1.0), (-1.0, 1.0)]
    f = field.evaluate_field(lattice.lattice_nodes(spark, box, 4), field.bump_metric())
    spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.9, 0.9])], "id long, coord array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, coord array<double>").parquet(str(tmp_path / "in"))
    q = write_parquet(stream_lookup(stream, box, 4, f), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = {r["id"]: r["g"][0] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == pytest.approx(2001.0) and got[1] == pytest.approx(1.0)


def test_radius_join_is_no_nested_loop(spark, capsys):
    p = spark.range(100).select("id", F.array(F.rand(1), F.rand(2)).alias("coord"))
    lattice.radius_edges(p, 0.1).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
