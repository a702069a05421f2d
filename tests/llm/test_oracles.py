"""Every query with an SQL form against DuckDB on a given folder."""

import pytest

from attesta.llm.queries import ORACLES
from tools.check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", list(ORACLES))
def test_oracle(spark, key):
    ok, note = compare(key, spark, connect(FOLDER), FOLDER)
    assert ok, note
