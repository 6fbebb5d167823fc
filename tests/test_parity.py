import pytest
from parity import compared, rows

from tidings.plans import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_its_sql(spark, name):
    compared(spark, name, all_queries()[name], all_oracles()[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_query_without_sql_has_rows_and_reruns_agree(spark, name):
    once, again = (rows(all_queries()[name](spark, FOLDER).toPandas().map(str)) for _ in range(2))
    assert once and once == again
