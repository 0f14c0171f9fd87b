"""Every registered query against its DuckDB oracle at sf0.001: row count,
column names and an order-insensitive value hash (the driver's gate, in pytest)."""
from __future__ import annotations

import importlib.util
import os
import sys

import duckdb
import pytest

from conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "scripts"))
from oracle_check import TABLES, digest  # noqa: E402


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry_o", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


ENTRY = _entry()
ORACLE = ENTRY.oracle_sql()
RELATIONAL = sorted(ENTRY.catalog.QUERIES)  # the training-data queries have their own tests


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", RELATIONAL)
def test_query_matches_oracle(spark, duck, name):
    assert name in ORACLE, f"{name} has no oracle"
    df = ENTRY.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.execute(ORACLE[name])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    assert len(srows) == len(orows)
    assert digest(df.columns, srows) == digest(ocols, orows)
