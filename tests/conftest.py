from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate columns over one row given as {name: (value, type)}; returns the values."""
    def run(columns, **values):
        schema = ", ".join(f"{n} {t}" for n, (_, t) in values.items())
        df = spark.createDataFrame([tuple(v for v, _ in values.values())], schema)
        row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return tuple(row)
    return run


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
