"""Every job against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tracemill.jobs import analysis, outputs, sentences, texts

SF = "/root/testdata/sf0.001"
JOBS = analysis.QUERIES | texts.QUERIES | outputs.QUERIES | sentences.QUERIES
SQL = analysis.ORACLE_SQL | texts.ORACLE_SQL | outputs.ORACLE_SQL | sentences.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer events documents embeddings orders labels".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def near(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_job(spark, con, name):
    df = JOBS[name](spark, SF)
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert got
    if name in SQL:
        rel = con.sql(SQL[name])
        columns = sorted(rel.columns)
        assert columns == sorted(df.columns)
        want = [tuple(dict(zip(rel.columns, r))[c] for c in columns) for r in rel.fetchall()]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert len(got) == len(want) and all(near(x, y) for a, b in zip(sorted(got, key=key), sorted(want, key=key)) for x, y in zip(a, b))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
