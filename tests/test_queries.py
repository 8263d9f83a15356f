"""Every registered query of the reference's operators against DuckDB."""

import pytest

from loomgraph.jobs import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(name, same_as_oracle, sf_dir):
    same_as_oracle(QUERIES[name], SQL[name], sf_dir)


def test_every_query_has_sql_but_the_sequential_one():
    assert set(QUERIES) - set(SQL) == {"graph_tour", "mem_english_topk"}
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
