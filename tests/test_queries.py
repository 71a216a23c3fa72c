"""Every query with an oracle gives the same rows as its SQL in DuckDB."""

import duckdb
import pytest

from metricgraph.plans import anomalies, fields, files, graphs, models, paths  # noqa: F401
from metricgraph.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    ours, theirs = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert len(ours) == len(theirs)
    for c in columns:
        if "f" in (ours[c].dtype.kind, theirs[c].dtype.kind):
            a, b = ours[c].astype(float), theirs[c].astype(float)
            assert (a.isna() == b.isna()).all() and (a.fillna(0) - b.fillna(0)).abs().max() <= 2e-6, c
        else:
            assert (ours[c].astype(str) == theirs[c].astype(str)).all(), c
