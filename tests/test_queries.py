"""Registered queries next to their SQL. SETTLEGRID_ALL_QUERIES=1 runs every one of them."""
import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = ["screening_input_summary", "latest_revision", "conflicting_revisions", "quality_table", "welch_spectral_features",
         "temporal_features", "seasonal_naive_cases", "rolling_features", "common_case_scores", "recurrence_summary",
         "half_hour_temperature", "grid_region_weights", "association_by_scope", "pooled_spearman", "label_silhouette",
         "seasonal_ar_forecast"]
NAMES = sorted(entry.queries()) if os.environ.get("SETTLEGRID_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, message = compare(spark, name, entry.queries()[name], entry.oracle_sql().get(name), SF, con)
    assert ok, message


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 8
