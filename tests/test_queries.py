"""Registered queries against their DuckDB forms on the smallest tables."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from pagelens import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return x


def table(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(cell(v.item() if hasattr(v, "item") else v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    got, want = table(plans.QUERIES[name](spark, SF).toPandas()), table(duck.execute(plans.ORACLES[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-5)) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["join10_flatten_runs", "agg19_run_rates", "agg19_run_rates_by_page", "agg19_run_rates_by_type", "ret11_14_ranking_metrics"])
def test_runs_shuffle_no_postings(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"hashpartitioning\([^)]*(term|chunk_index)#", plan)


def test_run_plans_make_no_row_for_a_rectangle(spark):
    plan = plans.QUERIES["img12_run_plans"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "Python" not in re.sub("PythonUDF|MapInArrow", "", plan)
