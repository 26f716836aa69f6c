"""Every registered query of the engine against its SQL, or for a result where SQL can't say it."""

import pytest

import __spark_entry__ as entry_module
from profseg.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_equals_sql(spark, duck, same, name):
    same(QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
