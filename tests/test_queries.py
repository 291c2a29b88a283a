"""Every registered query against its SQL, run by DuckDB over the same files."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tidemark.catalog.oracles import SQL
from tidemark.catalog.queries import REGISTRY

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [
        tuple("NaN" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order)
        for r in rows
    ]
    return sorted(plain, key=repr)


def test_every_query_has_its_sql():
    assert set(REGISTRY) == set(SQL)
    assert set(REGISTRY) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = contract.queries()[name](spark, str(TABLES))
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted_rows(columns, cursor.fetchall())
    assert sorted_rows(got.columns, got.collect()) == want
    assert want


def test_the_contract_can_be_imported_before_there_is_a_session():
    root = Path(contract.__file__).parent
    done = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"],
        cwd=root, capture_output=True, text=True, timeout=120,
    )
    assert done.returncode == 0 and int(done.stdout) >= len(REGISTRY), done.stderr


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
