"""Every registered query against its DuckDB oracle (row count, column names,
order-insensitive values), on the smallest driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from baitline.plans import oracle, queries
from baitline.sources.fixtures import TABLES

from .conftest import SF_SMALL

# optional subpackages test their own queries
ORACLE = dict(oracle.ORACLE)
QUERIES = dict(queries.REGISTRY)


def _norm(v):
    if v is None:
        return "∅"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == {"classifier_fit", "plugin_scorer"}
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    s = QUERIES[name](spark, SF_SMALL).toPandas()
    d = con.execute(ORACLE[name]).df()
    cs, rs = _rows(s)
    cd, rd = _rows(d)
    assert cs == cd
    assert len(rs) == len(rd)
    assert rs == rd


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 8
    assert df.columns == ["metric", "min", "max", "median", "mean", "std"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_have_no_cross_join_or_python_in_hot_path(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert op not in plan, (name, op)
    if name != "plugin_scorer":          # the model plug-in is Python by design
        assert "MapInPandas" not in plan
