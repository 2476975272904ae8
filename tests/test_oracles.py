"""Every registered query runs, and equals its SQL counterpart on the same tables."""

import decimal
import importlib.util
import math
from pathlib import Path

import duckdb
import pytest

# At the smallest scale some groups have too few rows to be compared at all.
FOLDER = "/root/testdata/sf0.01"
ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def shown(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float) and not math.isnan(value) and value == int(value):
        return str(int(value))
    return str(value)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(theirs)
    order = sorted(df.columns)
    ours = sorted(tuple(shown(row[c]) for c in order) for row in rows)
    index = [theirs.index(c) for c in order]
    expected = sorted(tuple(shown(row[i]) for i in index) for row in cursor.fetchall())
    assert ours == expected
