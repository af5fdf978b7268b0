"""Every registered query against its SQL on the same tables."""

import pytest

from compare import difference, oracle_connection
from tallyloom.workload.oracles import all_oracles
from tallyloom.workload.queries import all_queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_same_keys():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_oracle(spark, sf_dir, con, name):
    assert difference(all_queries()[name](spark, sf_dir), con, all_oracles()[name]) is None


def test_entry_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert "total_cost_vnd" in df.columns
    assert df.limit(1).count() == 1


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_column_types_agree(spark, sf_dir, con, name):
    expected = {r[0]: r[1] for r in con.execute("DESCRIBE " + all_oracles()[name]).fetchall()}
    assert {c: DUCK_TYPES.get(t, t) for c, t in all_queries()[name](spark, sf_dir).dtypes} == expected
