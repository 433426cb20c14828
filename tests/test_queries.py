"""Every registered query against its SQL on the smallest tables (set WAYSPARK_ALL=1 for the slow ones)."""
import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# fits of models and whole evaluations without SQL twin: minutes in total, no value check here
SLOW = {n for n in QUERIES if n not in ORACLES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SLOW and not os.environ.get("WAYSPARK_ALL"):
        pytest.skip("slow, no SQL twin")
    problem, _, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert problem is None


def test_names():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "split" and df.count() == 3
