"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as contract
from tests.check import connect, differences

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 18


def test_replay_in_stream_and_batch_agree(spark, sf_dir):
    batch, stream = QUERIES["bandit_replay"](spark, sf_dir), QUERIES["stream_bandit"](spark, sf_dir)
    assert sorted(batch.collect()) == sorted(stream.collect())
