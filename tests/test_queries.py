"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import inspect

import pytest

import __spark_entry__ as contract
from catalumen import plans
from tests.oracle import compare, connect

QUERIES, ORACLES = plans.QUERIES, plans.ORACLES
WITHOUT_SQL = {"file_manifest", "manifest_drift"}


@pytest.fixture(scope="module")
def con(smoke_dir):
    return connect(smoke_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, smoke_dir, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], smoke_dir) is None


def test_only_file_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL and not set(ORACLES) - set(QUERIES)


def test_manifest_lists_all_files(spark, smoke_dir):
    import hashlib
    from pathlib import Path

    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(smoke_dir).glob("*.parquet")}
    got = {r["relative_path"]: r["sha256"] for r in QUERIES["file_manifest"](spark, smoke_dir).collect()}
    assert got == want
    assert {r["relative_path"] for r in QUERIES["manifest_drift"](spark, smoke_dir).collect()} == {"labels.parquet", "pages.parquet"}


def test_entry_is_lazy_and_has_the_curve(spark):
    frame = contract.entry(spark)
    assert frame.count() == 101 and "selective_risk" in frame.columns


def test_no_cross_joins_or_local_checkpoints():
    from pathlib import Path

    for path in Path("catalumen").rglob("*.py"):
        code = path.read_text()
        assert "crossJoin" not in code and "localCheckpoint" not in code, path
    assert inspect.isfunction(contract.entry)
