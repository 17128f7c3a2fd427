"""A spread of registered queries against their SQL twins; oracle_check.py runs all of them."""
import pytest
from conftest import SF
from oracle_check import compare

import __spark_entry__ as entry_module

SPREAD = ["a3_event_table", "a6_first_per_key", "b1_b10_compensation_features", "b13_demographics", "b17_time_in_current", "b24_change_counts",
          "b27_promotion_events", "b34_neighborhood_salary_ratio", "c4_feature_ranges", "d7_completeness", "e4_frequency_codes",
          "f1_km_curve_by_stratum", "f6_log_rank", "g1_log_likelihood", "i5_integrated_brier", "i6_time_dependent_auc", "i8_concordance",
          "i9_ece_ipcw", "j1_fit_calibration", "j9_min_cost_threshold", "k1_risk_bands", "l5_average_effects", "m3_top_factors", "n5_km_log_likelihood"]


@pytest.mark.parametrize("name", SPREAD)
def test_matches_sql(spark, con, name):
    message, rows = compare(spark, con, SF, name)
    assert message == "" and rows > 0


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
