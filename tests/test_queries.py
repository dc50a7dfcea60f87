"""Registered queries against their SQL. FULL=1 runs all of them."""

import os

import pytest

import __spark_entry__ as entry
from massweave.queries import ORACLES
from tools.check import compare, duck

SAMPLE = ["a02_clean_table", "a08_parse_series_name", "a11_flatten_composition", "b01_norm_text", "b05_conflicts", "b08_classify", "b12_check_triangular",
          "c02_override_or_scale", "c11_balance", "c12_normalise", "d01_strict_lookup", "d06_contains_lookup", "d10_bracket_join", "d12_max_abs_diff",
          "e01_monotone_curve", "e02_shift_curve", "e05_substitute_marker", "e09_anchor_to_base", "f03_triangular", "f09_range_draws", "f18_calibrated_presence",
          "f21_material_draws", "f24_resample_bins", "g01_series_totals", "g02_hist_acc", "g05_hist_percentile", "g06_exact_percentiles", "g07_coarse",
          "g14_spearman", "g35_stream_hist", "w01_running_sum", "w03_row_id", "h02_top_k_per", "k02_motor_distribution", "k08_stream_elements", "k08_streams", "b03_dedup_report", "d06_contains_narrowed", "k06_board_sensitivity", "k07_motor_sensitivity", "k11_change_table", "g36_mean_by_year", "j07_binned_against_exact"]
NAMES = sorted(ORACLES) if os.environ.get("FULL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, name):
    out = compare(entry.queries()[name](spark, sf), duck(sf), entry.oracle_sql()[name])
    spark.catalog.clearCache()
    assert isinstance(out, tuple), out


def test_every_query_has_sql():
    from massweave import queries
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["segment", "level", "name", "year", "n", "mean", "std", "p025", "median", "p975", "mode"]
    assert df.count() > 0
