"""Queries against their SQL. A part runs by default; CHECK_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from harness import SF_DIR, connect, difference

QUICK = (
    "student_choices key_answer required_count gate project_box page_boxes box_algebra question_review f08_pairs associate enclosing "
    "annotate cascade consensus_sizes reconcile_shape recommend decide rec_views number_regions zone_bottoms row_groups key_audit grid_summary "
    "grading_groups validate_corrections overlay scan_range score_archive line_match stream_progress stream_corrections"
).split()
NAMES = list(entry.oracle_sql()) if os.environ.get("CHECK_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_check():
    from sheetwise.plans.catalog import check_sql, spark_queries

    assert set(spark_queries()) == set(check_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert difference(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == ""
    spark.catalog.clearCache()
