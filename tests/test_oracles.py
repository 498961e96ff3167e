"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01); queries without an oracle must run."""

import pytest

import __spark_entry__ as E
from riskflow.plans import registry
from tools.check_oracles import compare, duck

from .conftest import SF_SMALL

registry.load_all()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES  # the library's own; tests/llm has the others


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    ok, problems = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_SMALL, verbose=False)
    assert ok, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"risk_tier", "n", "mean_amount", "mean_probability"}


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_every_query_has_a_docstring():
    for name, fn in QUERIES.items():
        assert fn.__doc__, name
