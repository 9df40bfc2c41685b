"""Every core query with SQL gives the SQL's rows; the others give rows of a stable schema."""

import pytest

from lurus.plans.queries import QUERIES, SQL
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"category", "is_total", "n", "cer_before", "cer_after"} == set(e.entry(spark).columns)
