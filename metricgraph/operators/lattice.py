"""Lattices over a box, their edges, and query points tied to them."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricgraph.functions.arrays import Metric, coords, euclidean, flat, matrix_of, quadratic
from metricgraph.functions.storage import stored
from metricgraph.operators.distance import all_pairs, pair_distances, straight_line
from metricgraph.operators.field import Bounds, cell_of, within
from metricgraph.operators.paths import measure_paths, shortest_paths, walk_paths


def lattice_nodes(spark: SparkSession, bounds: Bounds, grid: int) -> DataFrame:
    """(cell, idx, coord) of all (grid + 1)^D nodes, row-major."""
    dims, n = len(bounds), grid + 1
    cell = F.col("id")
    idx = [F.floor(cell / (n ** (dims - 1 - d))) % n for d in range(dims)]
    coord = [F.lit(lo) + i * ((hi - lo) / grid) for i, (lo, hi) in zip(idx, bounds, strict=True)]
    return spark.range(n**dims).select(cell.alias("cell"), F.array(*(i.cast("int") for i in idx)).alias("idx"), F.array(*(c.cast("double") for c in coord)).alias("coord"))


def offsets(dims: int, moore: bool = True) -> list[tuple[int, ...]]:
    """Half of the neighbour offsets, those that lead to a greater cell id, so that every edge is made once."""
    half = [o for o in itertools.product((-1, 0, 1), repeat=dims) if o > (0,) * dims]
    return half if moore else [o for o in half if sum(map(abs, o)) == 1]


def lattice_edges(nodes: DataFrame, grid: int, dims: int = 2, moore: bool = True) -> DataFrame:
    """(src, dst) with src < dst between neighbouring nodes: 3^D - 1 (Moore) or 2 D neighbours (E2). No shuffle."""
    n = grid + 1
    steps = F.explode(F.array(*(F.array(*map(F.lit, o)) for o in offsets(dims, moore))))
    moved = nodes.select("cell", "idx", steps.alias("o")).withColumn("to", F.zip_with("idx", "o", lambda a, b: a + b))
    inside = moved.filter(F.forall("to", lambda x: (x >= 0) & (x < n)))
    to = F.aggregate("to", F.lit(0).cast("long"), lambda acc, x: acc * n + x)
    return inside.select(F.col("cell").alias("src"), to.alias("dst"))


def radius_edges(points: DataFrame, radius: float, dims: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """(src, dst, dist) with src < dst of points(id, coord) at most `radius` apart, over cells of that width.

    A pair of neighbouring cells meets once. The columns named in `carry` come along for both ends, as <name>_src and
    <name>_dst: they are shuffled with the points, a fixed number of times each, and not with the far more edges, as in a
    join afterwards. A broadcast would leave all pairs to the few tasks that read the points.
    """
    x, cells = coords(F.col("coord"), dims), [f"c{d}" for d in range(dims)]
    own = points.select("id", "coord", *carry, *(F.floor(v / radius).alias(c) for v, c in zip(x, cells, strict=True)))
    steps = F.explode(F.array(*(F.array(*map(F.lit, o)) for o in [(0,) * dims, *offsets(dims)])))
    near = own.select(F.col("id").alias("i"), F.col("coord").alias("a"), *(F.col(c).alias(f"{c}_i") for c in carry), *cells, steps.alias("o"))
    near = near.select("i", "a", *(f"{c}_i" for c in carry), *((F.col(c) + F.get("o", F.lit(d))).alias(c) for d, c in enumerate(cells)), F.forall("o", lambda k: k == 0).alias("same"))
    met = near.join(own.select(F.col("id").alias("j"), F.col("coord").alias("b"), *(F.col(c).alias(f"{c}_j") for c in carry), *cells).hint("merge"), cells)
    gaps = [v - u for u, v in zip(coords(F.col("a"), dims), coords(F.col("b"), dims), strict=True)]
    dist = F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))
    first = F.col("i") < F.col("j")
    held = met.filter((first | ((F.col("i") > F.col("j")) & ~F.col("same"))) & (dist <= radius))
    ends = [F.when(first, F.col(f"{c}_{u}")).otherwise(F.col(f"{c}_{v}")).alias(f"{c}_{n}") for c in carry for n, u, v in (("src", "i", "j"), ("dst", "j", "i"))]
    return held.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), dist.alias("dist"), *ends)


def full_edges(nodes: DataFrame, max_nodes: int = 3_000, force: bool = False) -> DataFrame:
    """(src, dst) with src < dst between all nodes (E4); more than max_nodes of them need force."""
    n = nodes.count()
    if n > max_nodes and not force:
        raise ValueError(f"{n} nodes have {n * (n - 1) // 2} pairs; pass force=True to make them all")
    return all_pairs(nodes.select(F.col("cell").alias("id"), F.lit(None).alias("coord")), force=True).selectExpr("i as src", "j as dst")


def weigh_edges(edges: DataFrame, positions: DataFrame, metric: Metric | None, kind: str = "geodesic", dims: int = 2) -> DataFrame:
    """(src, dst, weight): half the sum of sqrt(dT G d) at both ends, each form at least 1e-12; or the Euclidean length;
    or 1.0 (E5, E6). positions have (cell, coord), and without a metric g as well, as a field table has it."""
    g = [] if metric else ["g"]
    ends = edges.select("src", "dst").join(positions.selectExpr("cell as src", "coord as a", *(f"{c} as g0" for c in g)), "src").join(positions.selectExpr("cell as dst", "coord as b", *(f"{c} as g1" for c in g)), "dst")
    p, q = coords(F.col("a"), dims), coords(F.col("b"), dims)
    d = [y - x for x, y in zip(p, q, strict=True)]
    if kind == "geodesic":
        first, last = (metric(p), metric(q)) if metric else (matrix_of(F.col("g0"), dims), matrix_of(F.col("g1"), dims))
        w = 0.5 * (F.sqrt(F.greatest(quadratic(first, d), F.lit(1e-12))) + F.sqrt(F.greatest(quadratic(last, d), F.lit(1e-12))))
    elif kind == "euclidean":
        w = euclidean(F.col("a"), F.col("b"))
    elif kind == "unit":
        w = F.lit(1.0)
    else:
        raise ValueError(f"unknown weight kind: {kind}")
    return ends.select("src", "dst", w.alias("weight"))


def field_edges(field: DataFrame, bounds: Bounds, grid: int) -> DataFrame:
    """(src, dst, weight), src < dst, between the neighbours of a whole lattice, from its field(cell, coord, g) (E5).

    No join: each node makes its own half of the weight, sqrt(dT G d) / 2, of every edge that it is an end of, and the
    two halves of an edge are added. So a field row meets nothing but its own edges, and one exchange of small rows is all.
    A node that the field lacks has no edges.
    """
    dims, n = len(bounds), grid + 1
    ways = [o for o in itertools.product((-1, 0, 1), repeat=dims) if any(o)]
    idx = F.array(*((F.floor(F.col("cell") / (n ** (dims - 1 - d))) % n).cast("int") for d in range(dims)))
    moved = field.select("cell", "g", idx.alias("idx"), F.explode(F.array(*(F.array(*map(F.lit, o)) for o in ways))).alias("o")).withColumn("to", F.zip_with("idx", "o", lambda a, b: a + b))
    inside = moved.filter(F.forall("to", lambda x: (x >= 0) & (x < n)))
    step = [F.get("o", F.lit(d)) * ((hi - lo) / grid) for d, (lo, hi) in enumerate(bounds)]
    half = 0.5 * F.sqrt(F.greatest(quadratic(matrix_of(F.col("g"), dims), step), F.lit(1e-12)))
    to = F.aggregate("to", F.lit(0).cast("long"), lambda acc, x: acc * n + x)
    halves = inside.select("cell", to.alias("to"), half.alias("half"))
    both = halves.groupBy(F.least("cell", "to").alias("src"), F.greatest("cell", "to").alias("dst")).agg(F.sum("half").alias("weight"), F.count("*").alias("ends"))
    return both.filter("ends = 2").drop("ends")


def field_distances(field: DataFrame, ends: DataFrame, bounds: Bounds, grid: int, nearest: int = 8, hops: int = 1) -> DataFrame:
    """(i, j, search_cost, length) for pairs i < j of ends(id 0.., coord, g) over a lattice's field(cell, coord, g).

    The same as lattice_distances with a metric that exists as a table only, such as the pullback of a decoder; without g
    an end has the metric of its nearest node. Ends must lie within the bounds.
    """
    dims, base = len(bounds), (grid + 1) ** len(bounds)
    _checked(ends, bounds)
    if "g" not in ends.columns:
        ends = ends.withColumn("cell", cell_of(coords(F.col("coord"), dims), bounds, grid)).join(field.select("cell", "g"), "cell").drop("cell")
    field = stored(field.select("cell", "coord", "g"), "field")
    own = ends.select((F.col("id") + base).alias("cell"), "coord", "g")
    ties = attach_queries(field, ends, bounds, grid, nearest=nearest)
    one = field_edges(field, bounds, grid).union(weigh_edges(ties, field.union(own), None, dims=dims))
    return _found(one, field.union(own), ends, base, None, "geodesic", dims, hops, True)


def _checked(queries: DataFrame, bounds: Bounds) -> None:
    outside = queries.filter(~within(coords(F.col("coord"), len(bounds)), bounds)).limit(20).collect()
    if outside:
        raise ValueError(f"points out of bounds: {[(r['id'], list(r['coord'])) for r in outside]}")


def _found(one: DataFrame, positions: DataFrame, queries: DataFrame, base: int, metric: Metric | None, kind: str, dims: int, hops: int, remeasure: bool) -> DataFrame:
    """Search over edges of one direction from all queries, and the lengths of the paths that it found."""
    edges = one.union(one.selectExpr("dst as src", "src as dst", "weight"))
    labels = shortest_paths(edges, queries.select((F.col("id") + base).alias("source")), hops=hops)
    ends = queries.select((F.col("id") + base).alias("node"))
    found = labels.join(ends, "node").filter("source < node")
    out = found.select((F.col("source") - base).alias("i"), (F.col("node") - base).alias("j"), F.col("dist").alias("search_cost"))
    if not remeasure:
        return out
    paths = walk_paths(labels, found.select("source", "node"))
    lengths = measure_paths(paths, positions.withColumnRenamed("cell", "node"), metric, kind, dims)
    return out.join(lengths.select((F.col("src") - base).alias("i"), (F.col("dst") - base).alias("j"), "length"), ["i", "j"])


def node_features(nodes: DataFrame, metric: Metric, dims: int = 2) -> DataFrame:
    """(cell, features): position, index and flattened metric of each node."""
    g = flat(metric(coords(F.col("coord"), dims)))
    return nodes.select("cell", F.concat("coord", F.transform("idx", lambda x: x.cast("double")), g).alias("features"))


def attach_queries(nodes: DataFrame, queries: DataFrame, bounds: Bounds, grid: int, radius: float | None = None, nearest: int = 8, beyond: bool = True) -> DataFrame:
    """(src, dst) that tie queries(id, coord) to the lattice and to each other; query ids come after the cells.

    A query is linked with the nearest 8 nodes within twice the mean step, or with the nearest 8 at all if none is that
    near; queries within 1.5 mean steps are linked. Nodes are found over cells as wide as the radius, by an equi-join. For
    a query without a node in reach the nearest are looked up by their cell: they lie, axis by axis, among the `nearest`
    coordinates next to the query's own, so the nodes of a whole lattice are expected. Without `beyond` it has no nodes.
    """
    dims, base = len(bounds), (grid + 1) ** len(bounds)
    step = sum((hi - lo) / grid for lo, hi in bounds) / dims
    radius = 2.0 * step if radius is None else radius
    cell = F.transform("coord", lambda x: F.floor(x / radius))
    steps = F.explode(F.array(*(F.array(*map(F.lit, o)) for o in itertools.product((-1, 0, 1), repeat=dims))))
    q = queries.select("id", F.col("coord").alias("a"), cell.alias("c"), steps.alias("o")).select("id", "a", F.zip_with("c", "o", lambda x, y: x + y).alias("c"))
    near = q.join(nodes.select("cell", F.col("coord").alias("b"), cell.alias("c")), "c").select("id", "cell", euclidean(F.col("a"), F.col("b")).alias("dist")).filter(F.col("dist") <= radius)
    alone = queries.join(near.select("id").distinct(), "id", "left_anti")
    # Points outside the box or tiny radii come here. One axis after the other, each with at most 2 * nearest + 1 places.
    around = alone.select("id", F.col("coord").alias("a"), F.lit(0).cast("long").alias("cell"))
    for d, (lo, hi) in enumerate(bounds):
        own = F.least(F.greatest(F.round((F.get("a", F.lit(d)) - lo) / ((hi - lo) / grid)), F.lit(0)), F.lit(grid)).cast("long")
        place = F.explode(F.sequence(F.greatest(own - nearest, F.lit(0)), F.least(own + nearest, F.lit(grid))))
        around = around.select("id", "a", "cell", place.alias("k")).select("id", "a", (F.col("cell") * (grid + 1) + F.col("k")).alias("cell"))
    far = around.join(nodes.select("cell", F.col("coord").alias("b")), "cell").select("id", "cell", euclidean(F.col("a"), F.col("b")).alias("dist"))
    ranked = (near.union(far) if beyond else near).selectExpr("id", "cell", "row_number() over (partition by id order by dist, cell) as r").filter(F.col("r") <= nearest)
    own = ranked.select(F.col("cell").alias("src"), (F.col("id") + base).alias("dst"))
    return own.union(radius_edges(queries, 1.5 * step, dims).select((F.col("src") + base).alias("src"), (F.col("dst") + base).alias("dst")))


def lattice_distances(spark: SparkSession, queries: DataFrame, metric: Metric, bounds: Bounds, grid: int, kind: str = "geodesic", nearest: int = 8, hops: int = 1, remeasure: bool = True, force: bool = False) -> DataFrame:
    """(i, j, search_cost, length) for pairs i < j of queries(id 0.., coord) over the lattice.

    search_cost is the trapezoid cost that the search minimises, length the path measured again with the mean metric of
    each step's ends. Points outside the bounds raise an error that lists them, unless forced: forced points are tied to the
    nodes nearest to them. No row = unreachable.
    """
    dims = len(bounds)
    if not force:
        _checked(queries, bounds)
    base = (grid + 1) ** dims
    nodes = lattice_nodes(spark, bounds, grid).select("cell", "idx", "coord")
    positions = nodes.select("cell", "coord").union(queries.select((F.col("id") + base).alias("cell"), "coord"))
    pairs = lattice_edges(nodes, grid, dims).union(attach_queries(nodes, queries, bounds, grid, nearest=nearest))
    one = weigh_edges(pairs, positions, metric, kind, dims)
    return _found(one, positions, queries, base, metric, kind, dims, hops, remeasure)


def searched_table(points: DataFrame, metric: Metric, bounds: Bounds, grid: int, max_points: int = 20_000, force: bool = False) -> DataFrame:
    """pairs(i, j, dist) with i < j over all points(id 0.., coord) by the lattice mode (C9): no row = unreachable.

    As in distance_table, more points than max_points need force.
    """
    n = points.count()
    if n > max_points and not force:
        raise ValueError(f"{n} points have {n * (n - 1) // 2} pairs; pass force=True to make them all")
    return lattice_distances(points.sparkSession, points, metric, bounds, grid).select("i", "j", F.col("length").alias("dist"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, average degree, mean, sample deviation, least and greatest weight (E14). One row an edge."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"), F.avg("weight").alias("weight_mean"), F.stddev_samp("weight").alias("weight_std"), F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"))
    return n.crossJoin(e).withColumn("avg_degree", F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes")))


def path_report(spark: SparkSession, ends: DataFrame, metric: Metric, bounds: Bounds, grid: int, points: int = 50, force: bool = False) -> DataFrame:
    """(i, j, lattice_length, euclidean, straight) for all pairs of ends(id, coord); force as in lattice_distances."""
    pairs = all_pairs(ends, force=True)
    straight = pair_distances(pairs, straight_line(points, bounds), metric, len(bounds)).withColumnRenamed("dist", "straight")
    euclid = pair_distances(pairs, "euclidean", None, len(bounds)).withColumnRenamed("dist", "euclidean")
    lattice = lattice_distances(spark, ends, metric, bounds, grid, force=force).select("i", "j", F.col("length").alias("lattice_length"))
    return lattice.join(euclid, ["i", "j"]).join(straight, ["i", "j"])
