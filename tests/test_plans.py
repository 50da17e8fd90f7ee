"""Plans that have to hold at scale: pruned scans, no cross joins, pre-aggregation."""

import re

import pytest

from tensorloom.plans import queries

ALL = queries.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["tracer_t1w", "region_median", "pivot_first", "box_stats", "linregress", "mode_scale", "half_half_split", "mann_whitney_u", "avg_rank", "cv_pairs", "common_subjects", "gram", "component_pairs", "row_gather", "colour_limits", "spatial_limits", "subject_fits", "subject_boxes", "masked_overlay"])
def test_no_cross_join(spark, data, name):
    assert not re.search("CartesianProduct|NestedLoopJoin", plan(ALL[name](spark, data)))


def test_scans_read_only_what_they_need(spark, data):
    text = ALL["region_reduce_mean"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    lineitem = next(x for x in text.splitlines() if "Project" in x and "l_suppkey" in x)
    assert "l_extendedprice" not in lineitem and "l_partkey" not in lineitem
    scan = next(x for x in plan(ALL["linregress"](spark, data)).splitlines() if "FileScan" in x)
    assert "l_suppkey" not in scan.split("ReadSchema")[1]


def test_filters_reach_the_scan(spark, data):
    scan = next(x for x in plan(ALL["mask_and_label_filter"](spark, data)).splitlines() if "FileScan" in x)
    assert "l_quantity" in scan.split("PushedFilters")[1]


def test_aggregates_combine_before_the_shuffle(spark, data):
    assert "partial_sum" in plan(ALL["gram"](spark, data)) and "partial_" in plan(ALL["region_reduce_mean"](spark, data))
