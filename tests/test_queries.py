import pytest

import __spark_entry__ as entry
import compare
from wardspark.oracle import oracle_sql
from wardspark.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(oracle_sql())


def test_the_entry_holds_all_queries():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_check(spark, duck, name):
    line, same = compare.compare(spark, duck, FOLDER, name)
    assert same, line
