"""Corpus queries against DuckDB on the same tables, where SQL can express them."""

import pytest
from support import compare, duck

import __spark_entry__ as entry
from viewlens.llm.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    assert compare(QUERIES[name](spark, "/root/testdata/sf0.001"), duck("/root/testdata/sf0.001"), ORACLE[name]) == []


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{k}" for k in range(1, 14)), "pipeline"])
    assert set(ORACLE) <= set(entry.oracle_sql())
