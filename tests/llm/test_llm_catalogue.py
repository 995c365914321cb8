"""The queries of this subpackage against their SQL, on the smallest data set where there is one."""

import os
from pathlib import Path

import pytest
from oracle import connect, differences

from rillframe.llm.catalogue import ORACLES, QUERIES

DATA = Path(os.environ.get("RILLFRAME_DATA", "/root/testdata")) / "sf0.001"
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    more, fewer = differences(QUERIES[name](spark, str(DATA)), connect(DATA), ORACLES[name])
    assert not more and not fewer


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.columns and df.collect()
