"""Every registered query of the library against its SQL, or for rows alone."""

import pytest

from samplewright.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_has_rows(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
