"""The queries of the training-data operators against their SQL at the smallest scale."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
from compare import connect, difference

import __spark_entry__ as contract
from backuplake.llm.queries import load

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(load()[1]))
def test_query_agrees_with_sql(spark, name):
    got = contract.queries()[name](spark, SF_DIR).toPandas()
    assert difference(got, connect(SF_DIR).execute(contract.oracle_sql()[name]).df()) is None
