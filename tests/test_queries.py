"""Registered queries against their SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from ledgerlark.plans import artifact_sql, artifacts, oracle, queries  # noqa: F401

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def canon(rows, columns):
    cell = lambda v: None if v is None else round(float(v), 6) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return sorted((tuple(repr(cell(r[c])) for c in columns) for r in rows))


@pytest.mark.parametrize("name", list(oracle.SQL))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    mine = [r.asDict() for r in df.collect()]
    theirs = duck.execute(oracle.SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == columns
    assert canon(mine, columns) == canon([dict(zip(names, r, strict=True)) for r in theirs.fetchall()], columns)


def test_every_sql_has_its_query():
    assert set(oracle.SQL) <= set(queries.QUERIES)


def test_scans_in_batches_of_one_row(spark):
    """A batch without hits has the declared types all the same."""
    from ledgerlark.operators import text

    rows = spark.createDataFrame([(1, "none"), (2, "SEC. 4. For $5: Provided, That"), (3, ""), (4, None)], "k long, t string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = text.index(rows, "k", "t")
        assert [(r.k, r.amount, r.value) for r in found["dollar_amounts"].collect()] == [(2, "$5", 5)]
        assert [(r.k, r.label) for r in found["section_headers"].collect()] == [(2, "SEC. 4")]
        assert {r.k for r in text.chunk_table(rows, "k", "t", 2).collect()} == {1, 2}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
