import pytest

import __spark_entry__ as entry_module
from tessella.plans.catalog import QUERIES, SQL


def test_entry(spark, sf):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf, duck, same_rows, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) or name == "encode_onehot_other"
    if name in SQL:
        assert same_rows(got, duck(SQL[name]))
