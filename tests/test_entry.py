"""Registered queries against their SQL on the small tables, where those are."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from recordlake.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("RECORDLAKE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = tables.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    for f in (got, want):
        for c in columns:
            f[c] = [bytes(x).decode() if isinstance(x, (bytes, bytearray)) else x for x in f[c]]
    norm = lambda f: f[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(norm(got), norm(want), check_dtype=False)


def test_entry_imports_without_the_training_data_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "recordlake", tmp_path / "recordlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(said.stdout) == len(QUERIES)
