"""Registered queries against their DuckDB equivalents.

A sample of them by default; all with CHECK_ALL=1 (``python -m verification.compare`` does the same
at any scale).
"""

import os

import pytest

import __spark_entry__ as entry_module
from verification.base import ORACLES, QUERIES
from verification.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
DEFAULT = [
    "a7_split_cells", "a12_kde_mode", "a14_summary_weighted", "a14_summary_ties", "a15_histogram",
    "a16_axis_limits_ungrouped", "d2_upsert_union", "d4_first_wins_rows", "f3_footnote_list",
    "f8_period_date", "f12_month_sequence", "f16_percent_text", "g1_growth_components",
    "g2_group_summary", "g4_right_tail", "g5_panel", "g8_series_view", "j3_year_over_year", "a13_kde_tails", "r10_document_scan",
    "k3_append_load", "k6_upsert_observations", "k8_landing_refresh", "k14_orphans",
    "r1_tab_separated_scan", "r8_multi_file_scan", "s1_label_order", "w4_extreme_examples",
]
# Their thresholds leave no rows at the smallest scale.
TOO_SMALL = {"p5_sample_guard", "g5_panel_code_length"}
CHOSEN = DEFAULT
if os.environ.get("CHECK_ALL"):
    CHOSEN = [name for name in ORACLES if name not in TOO_SMALL]


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_oracle(spark, connection, name):
    assert compare(spark, connection, name, SF_DIR) is None


def test_registry():
    """Every query of the library itself has an oracle, with the corpus operators or without them."""
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    result = entry_module.entry(spark)
    assert result.columns[:2] == ["date", "group_label"] and result.count() > 0
