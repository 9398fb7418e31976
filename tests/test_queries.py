"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from tests.oracle import expected, rows
from twinweave.plans.oracles import ORACLE_SQL
from twinweave.plans.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == expected(ORACLE_SQL[name], sf)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.where("is_duplicate").count() > 40
    assert {"group_id", "name", "item_count"} <= set(out.columns)
