"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import compare
from tables import SMALL

import __spark_entry__ as entry

from guardlake.plans.registry import all_queries
from oracle import all_sql

QUERIES, ORACLES = all_queries(), all_sql()
NO_SQL = {"scan_nested_encoding", "retrieve_index"}


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - NO_SQL))
def test_query_equals_sql(spark, duck, key):
    verdict, _ = compare(spark, duck, SMALL, QUERIES[key], ORACLES[key])
    assert verdict == "ok"


def test_entry_registers_them_all():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
