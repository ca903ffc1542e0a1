"""The registry, the driver contract, and a few queries against DuckDB."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from tests.conftest import SMALL, plan_of
from workload import REGISTRY

INVENTORY = (
    [f"S{i}" for i in (1, 2, 3, 5, 6)]
    + [f"K{i}" for i in range(1, 9)]
    + [f"P{i}" for i in range(1, 5)]
    + [f"R{i}" for i in range(1, 5)]
    + [f"W{i}" for i in range(1, 12)]
    + [f"J{i}" for i in range(1, 5)]
    + [f"A{i}" for i in range(1, 20)]
    + [f"F{i}" for i in range(1, 6)]
    + [f"O{i}" for i in range(1, 5)]
    + [f"H{i}" for i in range(1, 5)]
    + [f"C{i}" for i in range(1, 19)]
    + [f"I{i}" for i in range(1, 6)]
    + [f"L{i}" for i in range(1, 4)]
    + ["U1"]
)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_every_operator_has_a_query():
    covered = {c for q in REGISTRY.values() for c in q.covers}
    # S4, the database scan, needs a database and has a test of its options only.
    assert covered == set(INVENTORY)


def test_contract_maps_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in entry.queries())


def test_all_sql_parses(db):
    for name, sql in entry.oracle_sql().items():
        assert db.execute(f"EXPLAIN {sql}").fetchall(), name


def test_entry_plan(spark):
    df = entry.entry(spark)
    plan = plan_of(df)
    assert "BroadcastHashJoin LeftSemi" in plan and "CartesianProduct" not in plan
    assert df.count() > 0


@pytest.mark.parametrize(
    "name",
    [
        "join_allow",
        "join_left_count_distinct",
        "clean_all",
        "column_profile",
        "correlation_pairwise",
        "histogram",
        "key_ranges_repeated",
        "sample_systematic_file_order",
        "time_ranges_narrow",
        "incremental_stream",
        "extract_run",
    ],
)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())
