"""Every registered query against its SQL twin, and what its plan must not contain."""

import pytest

import __spark_entry__ as entry
from attesta.catalog import QUERIES
from tools.check_oracles import canonical, connect

FOLDER = "/root/testdata/sf0.001"
KEYS = list(QUERIES)
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, duck, key):
    frame = entry.queries()[key](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("BatchEvalPython", "CartesianProduct", "NestedLoopJoin"):
        assert forbidden not in plan
    rows = [tuple(r) for r in frame.collect()]
    if key not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[key])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canonical(rows, frame.columns) == canonical(result.fetchall(), columns)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["trust_level", "chunks", "sources", "characters"]
    assert frame.count() > 0


def test_every_query_has_an_oracle():
    assert set(KEYS) - set(ORACLES) == set()
