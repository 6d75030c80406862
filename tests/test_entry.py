"""Every registered query against its SQL twin on the smallest tables, and plan checks."""

import math
from pathlib import Path

import duckdb
import pytest
from conftest import plan_of

import __spark_entry__ as registry

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def test_every_query_has_a_twin():
    assert set(registry.panel_queries()) == set(registry.panel_sql())


@pytest.mark.parametrize("name", sorted(registry.panel_queries()))
def test_query(spark, oracle, name):
    df = registry.panel_queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    found = oracle.execute(registry.panel_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(([plain(r[i]) for i in order] for r in found.fetchall()), key=repr)
    assert got == expected
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert bad not in plan_of(df)


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["zip_code", "avg_property_crime_count"]
    assert df.count() > 0


def test_exact_join_builds_cells_once_and_deals_rows_out_by_point(spark, monkeypatch):
    written, staged = [], registry.spatial.staged
    monkeypatch.setattr(registry.spatial, "staged", lambda df, name, *rest: written.append(name) or staged(df, name, *rest))
    plan = plan_of(registry.panel_queries()["spatial_exact"](spark, FOLDER))
    assert written.count("cells") == written.count("area_rows") == 1
    assert "ZIP_Code" not in "".join(line for line in plan.splitlines() if "hashpartitioning(l_orderkey" in line)
    assert "hashpartitioning(l_orderkey" in plan
