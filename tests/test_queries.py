"""Every registered query of the core against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle_check
from strandmill.plans import registries

#: Queries that SQL cannot say; another test compares them with brute force.
WITHOUT_SQL = {"R07_diversified_articles"}
NAMES = [(n, f, r.sql.get(n)) for r in registries() for n, f in r.queries.items()]


@pytest.fixture(scope="module")
def con(folder):
    return oracle_check.connect(folder)


@pytest.mark.parametrize("name,query,sql", NAMES, ids=[n for n, _, _ in NAMES])
def test_same_as_sql(spark, folder, con, name, query, sql):
    line = oracle_check.compare(spark, con, name, query, sql, folder)
    assert "DIFFERENT" not in line, line
    assert (sql is None) == (name in WITHOUT_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
