"""Every registered query against its SQL at the smallest scale."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract
from backuplake.plans import load
from compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(load()[0]))
def test_query_agrees_with_sql(spark, con, name):
    got = contract.queries()[name](spark, SF_DIR).toPandas()
    assert name in ORACLES
    assert difference(got, con.execute(ORACLES[name]).df()) is None


def test_every_inventory_row_has_a_query():
    counts = {"src": 6, "snk": 5, "prj": 6, "flt": 13, "jn": 12, "agg": 23, "win": 10, "srt": 7, "set": 3, "fn": 14}
    counts |= {"str": 12, "ml": 16, "job": 18}
    names = {"_".join(n.split("_")[:2]) for n in contract.queries()}
    missing = {f"{k}_{i:02d}" for k, n in counts.items() for i in range(1, n + 1)} - names
    assert not missing


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
