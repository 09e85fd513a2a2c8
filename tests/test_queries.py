"""Every query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from siltstone.plans.oracle import ORACLE_SQL
from siltstone.plans.queries import NO_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return db


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else float(v) if hasattr(v, "as_tuple") else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) | set(NO_SQL) and not set(ORACLE_SQL) & set(NO_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, con, name):
    frame = QUERIES[name](spark, sf)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(str([plain(v) for _, v in sorted(zip(columns, r, strict=True))]) for r in cursor.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(columns)]) for r in frame.collect()) == want and want
