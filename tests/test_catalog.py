import pytest
from oracle import connect, rows

from tabulark.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got, columns = rows(QUERIES[name](spark, SF).toArrow())
    if name in SQL:
        want, names = rows(con.execute(SQL[name]).to_arrow_table())
        assert columns == names
        assert got == want
    else:
        assert len(got) == 500
