import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import assert_same

from transitspark.jobs import catalogue


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    assert_same(catalogue.QUERIES[name](spark, sf_dir), sf_dir, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
