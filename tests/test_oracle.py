"""Every registered query against its DuckDB oracle SQL on the sf0.001 tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from broodline.plans import queries as core  # noqa: E402
from oracle_check import duck, rows_of, type_mismatches  # noqa: E402

from .conftest import SF_SMALL

QUERIES = dict(core.QUERIES)
SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


#: solved by matrices and a search over penalties: compared with numpy in test_smooth.py
NO_SQL = {"fledge_smooth", "lay_day_smooth"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) - NO_SQL == set(SQL)


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert not [op for op in FORBIDDEN if op in plan_text(df)]
    assert df.count() > 0 and df.where("fit is null").isEmpty()


# physical operators that must never appear: all-pairs joins and Python on the data path
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    plan = plan_text(sdf)
    assert not [op for op in FORBIDDEN if op in plan], plan
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert type_mismatches(sdf, con, SQL[name]) == []
    srows = sorted(rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]))
    drows = sorted(rows_of(dcols, res.fetchall()))
    assert len(srows) == len(drows)
    assert srows == drows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["pop", "female", "year", "multi_partner", "event_code"]
    assert df.count() > 0
