"""Every registered query against its DuckDB SQL."""

import pytest
from oracle import compare

from __spark_entry__ import entry
from dockyard.plans.oracles import ORACLES
from dockyard.plans.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() == 1500


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    verdict, rows = compare(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name])
    assert verdict == "ok"
    assert rows > 0
