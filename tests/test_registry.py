"""Every registered query vs its DuckDB oracle on the small fixture, plus the
driver contract."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_mod  # noqa: E402
from wearline.sources.tables import TABLES  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def _norm(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else ("f", round(v, 5))
    if hasattr(v, "item"):
        return _norm(v.item())
    return ("v", str(v))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_contract_shape():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0 and "alert_active" in df.columns


@pytest.mark.parametrize("name", sorted(entry_mod.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = entry_mod.queries()[name](spark, SF_SMALL)
    rows = [r.asDict() for r in df.collect()]
    cols = sorted(df.columns)
    res = con.execute(entry_mod.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = [dict(zip(dcols, r)) for r in res.fetchall()]
    assert sorted(dcols) == cols
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in rows)
    b = sorted(tuple(_norm(r[c]) for c in cols) for r in drows)
    assert a == b
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in PYTHON_NODES), "relational query left the JVM"
