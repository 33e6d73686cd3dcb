"""Results must not depend on the session time zone (wall-clock timestamps)."""

import pytest

import __spark_entry__ as E
from compare import compare
from conftest import SF_SMALL

NAMES = ["semantic_lap_metrics", "semantic_weather", "q02_season_calendar", "lap_end", "status_case",
         "asof_view_purchase", "point_in_interval", "q08_lap_intervals"]


@pytest.mark.parametrize("tz", ["America/New_York", "Asia/Kolkata"])
def test_queries_independent_of_session_time_zone(spark, duck_small, tz):
    qs, sql = E.queries(), E.oracle_sql()
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", tz)
    try:
        for n in NAMES:
            problems, _, _ = compare(qs[n](spark, SF_SMALL), duck_small, sql[n])
            assert not problems, f"{n} under {tz}: {problems}"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
