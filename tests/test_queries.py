"""Every registered query, next to its SQL where there is one."""

from __future__ import annotations

import pytest
from compare import connect, spark_rows, sql_rows
from conftest import SMALL

import __spark_entry__ as entry

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    names, rows = spark_rows(QUERIES[name](spark, SMALL))
    if name in ORACLES:
        assert (names, rows) == sql_rows(db, ORACLES[name])
    else:
        assert rows


def test_entry_reaches_a_model(spark):
    steps = [(r.title, r.status) for r in entry.entry(spark).orderBy("position").collect()]
    assert steps[-1] == ("Model ready", "done")
    assert {status for _, status in steps} == {"done"}


@pytest.mark.parametrize("name", ["m_nearest", "g_ledger_replay", "t_split_stratified", "x_turns"])
def test_one_partition_gives_the_same(spark, db, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert spark_rows(QUERIES[name](spark, SMALL)) == sql_rows(db, ORACLES[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
