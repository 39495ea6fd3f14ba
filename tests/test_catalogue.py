"""Every query that has SQL gives the rows of its SQL."""

import pytest

from colsense.plans.catalogue import ORACLE_SQL, QUERIES
from tests.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, SF, name, QUERIES[name], ORACLE_SQL[name]) is None


def test_samples_have_their_size(spark):
    assert QUERIES["sample_rows"](spark, SF).count() == QUERIES["contiguous_block"](spark, SF).count() == 4 * 150


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["column_name", "name", "categories", "field_type"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
