"""Every registered query of the core against its SQL, and the rest for running at all."""

import importlib

import pytest

MODULES = [importlib.import_module(m) for m in ("cairnlake.plans.queries", "cairnlake.plans.code", "cairnlake.plans.functions", "cairnlake.plans.pipeline")]
QUERIES = {k: v for m in MODULES for k, v in m.queries().items()}
SQL = {k: v for m in MODULES for k, v in m.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(name, spark, data):
    df = QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
