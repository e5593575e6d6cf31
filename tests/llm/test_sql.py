"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from quillmatch.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
