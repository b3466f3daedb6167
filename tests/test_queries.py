"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import datetime
import math
import os

import pytest

from foliant.queries import ORACLES, QUERIES, TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    got = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(norm(r[i]) for i in at)) for r in sql.fetchall())


def test_plans_have_no_python(spark):
    for name, f in QUERIES.items():
        assert "Python" not in f(spark, SF)._jdf.queryExecution().optimizedPlan().toString(), name


def test_lookup_rewrites(spark):
    plan = lambda n: QUERIES[n](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan("l_anti") and "LeftSemi" in plan("l_semi")
    for name in ("l_eq_unwind", "l_anti", "l_semi", "q_shipping_priority", "q_nation_revenue"):
        assert "collect_list" not in plan(name)


def test_lookups_read_once(spark):
    """A sub-pipeline with equalities only is grouped by the foreign key: the local side is read once, and no row ids join back."""
    for name, local in (("l_pipeline_eq", "o_orderkey"), ("l_pipeline_group", "r_name"), ("l_pipeline_sort_limit", "r_name")):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Relation" in line and local in line for line in plan.splitlines()) == 1, name
        assert plan.count("monotonically_increasing_id") <= 2, name


def test_large_result_without_variables(spark, monkeypatch):
    """The result that every document would hold is refused above its limit."""
    from foliant.operators import lookup

    monkeypatch.setattr(lookup, "MOST_BYTES", 100)
    with pytest.raises(Exception, match="more than 100 bytes"):
        QUERIES["l_uncorrelated"](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['foliant.llm'] = None\nimport foliant.queries, foliant.sources, foliant.streaming, foliant.server\nassert not any(m.startswith('foliant.llm.') for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0
