import os

import pytest

from foldspan import plans
from oracle import connect, same

SF = "/root/testdata/sf0.001"
SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, db, name):
    df = plans.queries()[name](spark, SF)
    if name in SQL:
        same(db, df, SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).count() > 0
