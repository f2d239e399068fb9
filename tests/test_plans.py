"""Physical plans: what reaches the scan, what is shuffled, what stays out of Python."""

import re

import pytest

import __spark_entry__ as entry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def df_scan(p):
    """The columns that the first Parquet scan reads."""
    return {c.split("#")[0] for c in re.search(r"FileScan parquet \[([^\]]*)\]", p).group(1).split(",")}


@pytest.fixture(scope="module")
def queries():
    return entry.queries()


def test_filters_and_columns_reach_the_scan(spark, data, queries):
    p = plan(queries["asof_airports"](spark, data))
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(valid_from", p)
    read = df_scan(p)
    assert "name" in read and "keywords" not in read and "municipality" not in read and "latitude_deg" not in read


@pytest.mark.parametrize("name", ["asof_airports", "segment_merge", "airway_chain", "telemetry_progress", "reconcile_pairs", "nearby_topk", "p1_found", "p6_found", "validation_counts"])
def test_stays_in_the_jvm(spark, data, queries, name):
    p = plan(queries[name](spark, data))
    assert "Python" not in p and "Pandas" not in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_near_pairs_are_range_partitioned_and_swept(spark, data, queries):
    p = plan(queries["p7_found"](spark, data))
    assert "rangepartitioning(strip" in p and "MapInArrow" in p and "Join" not in p


def test_snapshots_are_read_once_and_range_merged(spark, data, queries):
    p = plan(queries["p1_found"](spark, data))
    assert "rangepartitioning(series" in p and p.count("dataset_rows.parquet") <= 1


def test_top_k_does_not_sort_all(spark, data, queries):
    assert "TakeOrderedAndProject" in plan(queries["nearby_topk"](spark, data))
