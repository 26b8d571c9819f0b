import os, sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import pytest

from oracle import rows_of, rows_of_sql, views
from tessera.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(DIR)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    made = rows_of(catalogue.QUERIES[name](spark, DIR))
    if name in catalogue.ORACLES:
        assert made == rows_of_sql(con, catalogue.ORACLES[name])
    else:
        assert made[0]
