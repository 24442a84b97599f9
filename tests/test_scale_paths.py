"""The ways taken past the limits give the same results, and plans stay free of what does not scale."""

import re

import pytest

import __spark_entry__ as entry
from airgrid.operators import binding
from check import canonical
from conftest import SF_DIR


@pytest.mark.parametrize("name", ["point_in_polygon_join", "clip_all_touched", "bilinear_regrid", "focal_mean", "kde_by_group",
                                  "boxplot_stats", "nearest_axis_asof", "group_kfold", "files_for_tiles", "align_by_day"])
def test_without_broadcast(name, spark, duck, monkeypatch):
    monkeypatch.setattr(binding, "BROADCAST_CELLS", -1)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = canonical(entry.queries()[name](spark, SF_DIR).toPandas())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = canonical(duck.sql(entry.oracle_sql()[name]).df())
    assert got.equals(want)


@pytest.mark.parametrize("name", ["hourly_average", "daily_weighted_average", "nearest_cell_join", "match_counts", "bilinear_regrid",
                                  "regrid_between_satellites", "clip_to_region", "kde_curve", "robust_limits", "kfold_assign",
                                  "hexbin_counts", "resample_dense", "axis_monotonic_check"])
def test_plans(name, spark):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)


def test_only_needed_columns_are_read(spark):
    plan = entry.queries()["yearly_mean"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["scan_grid"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,20.0)" in plan


def test_grids_on_a_day_keep_the_aggregate_partitioning(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["assign_points_to_grid"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 3  # sites, cells and the grid itself; none for the join
