"""What the plans must keep: filters and columns reach the scan, and built-ins stay built-ins."""

import re

import pytest
from support import DATA

import __spark_entry__
from sextant.operators import lookup as L
from sextant.plans.derived import Tables

SF = f"{DATA}/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    t = Tables(spark, SF)
    p = plan(L.where_equal(t.orders, o_orderstatus="F").select("o_orderkey"))
    assert "EqualTo(o_orderstatus,F)" in p and re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>", p)


def test_only_needed_columns_are_read(spark):
    p = plan(__spark_entry__.queries()["a01_feature_status"](spark, SF))
    assert "props" not in p and "value" not in p


def test_dead_code_is_an_anti_join(spark):
    p = plan(L.dead_symbols(Tables(spark, SF).symbols, Tables(spark, SF).edges))
    assert "LeftAnti" in p and "LeftSemi" in p


@pytest.mark.parametrize("name", ["a02_all_run_coverage", "a05_registry_metrics", "h05_feature_health", "h06_sprint_priority", "j04_declaration_owner", "r04_j03_nearest_symbol", "s02_go_results", "s04_vitest_results", "d02_symbols"])
def test_no_python_where_built_ins_do(spark, name):
    p = plan(__spark_entry__.queries()[name](spark, SF))
    assert not re.search("Python|Pandas|ArrowEval", p)
    assert "CartesianProduct" not in p
