"""Every registered query against its SQL on the driver's tables."""

from __future__ import annotations

import os

import pytest
from compare import connect, duck_rows, spark_rows, type_mismatches

from __spark_entry__ import entry
from storegrain.suite.oracles import ORACLES
from storegrain.suite.queries import REGISTERED

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_each_query_has_its_sql():
    assert REGISTERED.keys() == ORACLES.keys()


def test_entry(spark):
    assert entry(spark).columns[0] == "Customer ID"


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query(spark, db, name):
    df = REGISTERED[name](spark, SF_DIR)
    sql = ORACLES[name]
    columns, rows = spark_rows(df)
    wanted_columns, wanted = duck_rows(db, sql)
    assert columns == wanted_columns
    assert type_mismatches(df, db, sql) == []
    assert len(rows) == len(wanted)
    assert rows == wanted
