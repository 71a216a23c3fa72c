"""format("matrix"): byte ranges, rejects, inference, repeated and failed tasks."""

import json

import pytest

from metricgraph.sources import matrices
from metricgraph.sources.datasource import registered


@pytest.mark.parametrize("range_bytes", [1, 2, 3, 7, 10_000])
def test_every_line_is_read_once(spark, tmp_path, range_bytes):
    lines = [f"{i}, {i * i}.5" for i in range(40)]
    lines[7] = "7,seven"
    lines[11] = "1_1,2"
    (tmp_path / "m.csv").write_text("\n".join([*lines[:20], "", "  ", *lines[20:]]))  # no line break at the end
    found = matrices._lines(spark, str(tmp_path / "m.csv"), range_bytes=str(range_bytes)).orderBy("row").collect()
    assert [r["row"] for r in found] == list(range(40))
    assert [(r["row"], r["reject"]) for r in found if r["reject"] is not None] == [(7, "7,seven"), (11, "1_1,2")]
    assert all(r["values"] == [float(i), i * i + 0.5] for i, r in enumerate(found) if i not in (7, 11))


def test_parts_are_one_matrix_in_order(spark, tmp_path):
    rows = spark.range(1000).selectExpr("999 - id as k", "array(double(999 - id), 0.1D * (999 - id)) as values").repartition(7)
    matrices.write_matrix(rows, str(tmp_path / "m"), ["k"])
    coo, rejects = matrices.read_matrix(spark, str(tmp_path / "m"))
    assert {(r["row"], r["col"], r["value"]) for r in coo.collect()} == {(i, c, v) for i in range(1000) for c, v in ((0, float(i)), (1, 0.1 * i))} and rejects.isEmpty()
    kept = [json.loads(p.read_text()) for p in (tmp_path / "m").glob("_lines-*.json")]
    assert sum(kept[0].values()) == 1000 and not list((tmp_path / "m").glob("_temporary*"))
    matrices.write_matrix(rows.filter("k < 5"), str(tmp_path / "m"), ["k"])
    assert matrices.matrix_shape(matrices.read_matrix(spark, str(tmp_path / "m"))[0]).first()["rows"] == 1005


def test_tables_are_inferred(spark, tmp_path):
    (tmp_path / "t.csv").write_text(" name ; x;y\n a ;1;2\nb;3e2; 4\nc;5\n\nd;five;6\n")
    rows, rejects = matrices.read_table(spark, str(tmp_path / "t.csv"), ";")
    assert dict(rows.dtypes) == {"file": "string", "name": "string", "x": "string", "y": "double", "row": "bigint"}
    assert sorted((r["row"], r["name"], r["x"], r["y"]) for r in rows.collect()) == [(0, "a", "1", 2.0), (1, "b", "3e2", 4.0), (3, "d", "five", 6.0)]
    assert [(r["row"], r["line"]) for r in rejects.collect()] == [(2, "c;5")]
    source = registered(spark).read.format("matrix").option("path", str(tmp_path / "t.csv")).option("delimiter", ";").load()
    assert "name" in source.columns
    (tmp_path / "one.csv").write_text("4\n")  # one row of one column stays a matrix
    assert registered(spark).read.format("matrix").option("path", str(tmp_path / "one.csv")).load().first()["values"] == [4.0]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(0, "fine"), (1, "a,b")], "k int, s string")
    with pytest.raises(Exception, match="delimiter"):
        matrices.write_matrices(rows.selectExpr("1 as one", "s", "k"), str(tmp_path / "t"), "{one}.csv", "one", ["k"])
    assert not [p for p in (tmp_path / "t").rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="several tasks|side by side"):
        registered(spark).range(10).repartition(5).selectExpr("id % 2 as g", "id").write.format("matrix").option("path", str(tmp_path / "u")).option("files", "{g}.csv").mode("append").save()


def test_nothing_and_nulls(spark, tmp_path):
    empty = spark.createDataFrame([], "k int, values array<double>")
    matrices.write_matrix(empty, str(tmp_path / "m"), ["k"])
    (tmp_path / "m" / "part-0.csv").write_text("")
    assert matrices.read_matrix(spark, str(tmp_path / "m"))[0].isEmpty()
    with pytest.raises(Exception, match="FileNotFoundError|not found"):
        matrices.read_matrix(spark, str(tmp_path / "none"))[0].count()
