"""The driver contract, and every query of the guard against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from textwarden.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, wanted = QUERIES[name](spark, sf_dir), db.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns
