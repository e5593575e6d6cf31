"""Every query against the SQL that says the same, on the smallest tables."""

from __future__ import annotations

import pytest

from quillmatch.plans import io_queries, more_queries
from quillmatch.plans.oracles import ORACLE_SQL
from quillmatch.plans.queries import QUERIES
from tests.conftest import DATA, rows_of

SQL = ORACLE_SQL | io_queries.oracles() | more_queries.oracles()
ALL = QUERIES | io_queries.QUERIES | more_queries.QUERIES


def test_each_sql_has_a_query():
    assert set(SQL) <= set(ALL)
    assert set(ALL) - set(SQL) == {"html_anchors", "html_scan"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees(spark, duck, name):
    got, want = ALL[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
