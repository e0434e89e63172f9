"""A cross-section of the registered queries against DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.check_queries import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    "table_summary_orders_dirty", "profile_numeric_orders_nulls", "profile_categorical_events", "semantic_types_customer", "corr_all_lineitem", "spearman_pairs_part",
    "kendall_part", "leakage_nation_region", "mutual_info_lineitem", "f_test_lineitem", "detect_target_labels", "quality_simple_orders_dirty", "fair_detailed_customer",
    "readiness_orders_dirty", "readiness_samples_orders_dirty", "plan_simple_orders_dirty", "to_ml_orders_dirty", "oversample_orders", "encode_label_customer",
    "interactions_part", "psi_events_by_half", "drift_categorical_events_by_half", "baseline_grid_events", "clf_metrics_lineitem", "roc_auc_labels", "csv_round_trip_customer",
]


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert compare(got, want) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
