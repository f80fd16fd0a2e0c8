"""Every spatial query against its SQL oracle."""

import pytest

from terrafacet.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(name, same):
    same(catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_names_have_oracles():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_best_legend_is_one_of_three(spark, sf_dir):
    row = catalogue.QUERIES["legend_best"](spark, sf_dir).collect()
    assert len(row) == 1 and row[0]["name"] in {"log10", "even", "log"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["pid1", "pid2", "occurrences", "species"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
