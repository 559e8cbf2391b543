import pytest

import __spark_entry__ as contract
from checks.compare import difference, oracle_connection
from checks.oracle import ORACLE
from checks.registry import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in contract.queries().items() if name in REGISTRY}


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


def test_entry(spark):
    assert contract.entry(spark).columns == ["campaign_name", "ctr_percentage"]
    assert contract.entry(spark).count() == 5


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"user_documents", "user_history"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLE:
        assert difference(df, connection, ORACLE[name]) == ""
    else:
        assert df.count() > 0
