"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.helpers import duck, same_rows
from tidemark.catalog import OPS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("op", OPS, ids=lambda op: op.name)
def test_query_equals_oracle(spark, con, op):
    same_rows(op.query(spark, SF), op.oracle(), con)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    names = entry.queries()
    assert {op.name for op in OPS} <= set(names) and len({op.name for op in OPS}) == len(OPS)
    assert set(entry.oracle_sql()) <= set(names)
