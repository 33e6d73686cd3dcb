"""Scale guards on every registered query's physical plan."""

import pytest

from pyspark.sql import functions as F

from conftest import SF_SMALL
from pitwall.catalog import registered_queries
from pitwall.operators import gap_fill_linear, resample_linear
from pitwall.plans.context import RaceContext

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")
QUERIES = registered_queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loop_or_python(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    found = [op for op in FORBIDDEN if op in plan]
    assert not found, f"{name} plans {found}"


@pytest.mark.parametrize("model", ["fct_laps", "fct_stints", "fct_race_positions", "fct_pit_stops", "fct_session_results",
                                   "stg_laps", "stg_car_data"])
def test_build_plans_without_stored_models(spark, model):
    """The whole build of a model from the driver tables, not the stored copy."""
    plan = RaceContext(spark, SF_SMALL, materialize=False).table(model)._jdf.queryExecution().executedPlan().toString()
    found = [op for op in FORBIDDEN if op in plan]
    assert not found, f"{model} plans {found}"


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


@pytest.mark.parametrize("columns", [1, 2, 4])
def test_gap_fill_scans_do_not_grow_with_columns(spark, columns):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    cols = [f"v{i}" for i in range(columns)]
    df = ev.select("user_id", "ts", "event_id", *[F.col("value").alias(c) for c in cols])
    out = gap_fill_linear(df, ["user_id"], [F.col("ts"), F.col("event_id")], cols, bucket=("ts", 86400.0))
    assert scans(out) <= 4


def test_resample_indexes_its_input_once(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    out = resample_linear(ev, ["user_id"], [F.col("ts"), F.col("event_id")], "value", 50, bucket=("ts", 86400.0))
    assert scans(out) <= 2


# the sort of each verified query: column, descending
ORDERS = {"v01_races_happened_this_year": "session_start_at", "v03_race_winners_this_year": "session_start_at",
          "v04_driver_championship_standings": "championship_position", "v05_fastest_laps_last_race": "fastest_lap_s",
          "v06_pit_stop_performance": "avg_pit_s", "v07_cancelled_races_this_year": "session_start_at",
          "v08_upcoming_races_this_year": "session_start_at",
          "v09_constructor_championship_standings": "championship_position", "v10_driver_wins_this_season": "-wins",
          "v11_tyre_strategy_last_race": "driver_name", "v14_fastest_lap_each_race_this_season": "session_start_at",
          "v15_points_scored_per_driver_last_race": "finish_position"}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_verified_queries_sort(spark, name):
    col = ORDERS[name].lstrip("-")
    got = [r[col] for r in QUERIES[name](spark, SF_SMALL).collect()]
    known = [x for x in got if x is not None]
    assert known == sorted(known, reverse=ORDERS[name].startswith("-"))
    assert got[:len(known)] == known or col == "driver_name"
