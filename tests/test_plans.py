"""Shape of the physical plans: pruned scans, no unbounded products, no local checkpoints."""

import pathlib

import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["past_only_panel", "weighted_daily_weather", "binary_metrics", "daily_ranks", "covered_points", "first_valid_records", "budget_report"])
def test_no_cartesian_product_and_no_python_rows(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(queries()["cell_day_labels"](spark, FOLDER))
    assert "o_orderstatus" not in text and "c_name" not in text and "ReadSchema" in text


def test_filters_reach_the_scan(spark):
    text = plan(queries()["allowed_station_records"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(s_acctbal), GreaterThan(s_acctbal,0.0)" in text


def test_entry_has_rows_and_every_oracle_has_a_query(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())


def test_library_never_uses_local_checkpoints_or_crossjoin():
    for path in pathlib.Path(__file__).parent.parent.joinpath("panelspark").rglob("*.py"):
        text = path.read_text(encoding="utf-8")
        assert "localCheckpoint" not in text and ".crossJoin(" not in text, path
