"""Every registered query against its SQL counterpart, and the shape of its plan.

COHORTLOOM_SF_DIR picks another size; the smallest is the default to keep the tests quick.
"""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import compare, duck  # noqa: E402

from cohortloom.plans.queries import REGISTRY  # noqa: E402

FOLDER = os.environ.get("COHORTLOOM_SF_DIR", "/root/testdata/sf0.001")
PYTHON = {"confusion_exact"}  # limits of a few finished summary rows
OWN = set(REGISTRY)  # the training-data queries have tests of their own, beside theirs
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in OWN}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "EvalPython" not in plan or name in PYTHON
    assert compare(df, con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(OWN - set(SQL)))
def test_query_without_sql_returns_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "n_past_year" in df.columns
