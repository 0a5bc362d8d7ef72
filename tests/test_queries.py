import pytest
from textloom.queries import ORACLE_SQL, QUERIES

from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert differences(df, con, ORACLE_SQL[name]) == []
    else:
        assert df.count() > 0
