"""The declared data-quality checks, held apart from the engine's own list."""

from __future__ import annotations

# fixed values: table, column(s), test, severity
TEXT = """
dim_drivers              session_key                  not_null  error
dim_drivers              driver_number                not_null  error
dim_drivers              full_name                    not_null  error
dim_drivers              team_name                    not_null  warn
dim_sessions             session_key                  not_null  error
dim_sessions             session_name                 not_null  error
dim_sessions             session_key                  unique    error
fct_laps                 session_key                  not_null  error
fct_laps                 driver_number                not_null  error
fct_laps                 lap_number                   not_null  error
fct_laps                 lap_duration_s               not_null  error
fct_pit_stops            session_key                  not_null  error
fct_pit_stops            driver_number                not_null  error
fct_pit_stops            pit_duration_s               not_null  warn
fct_race_positions       session_key                  not_null  error
fct_race_positions       driver_number                not_null  error
fct_race_positions       position                     not_null  error
fct_stints               session_key                  not_null  error
fct_stints               driver_number                not_null  error
fct_stints               stint_number                 not_null  error
fct_stints               tyre_compound                not_null  error
fct_session_results      session_key                  not_null  error
fct_session_results      driver_number                not_null  error
fct_overtakes            session_key                  not_null  error
fct_overtakes            driver_overtaking            not_null  error
fct_overtakes            driver_overtaken             not_null  error
fct_intervals            session_key                  not_null  error
fct_intervals            driver_number                not_null  error
fct_intervals            recorded_at                  not_null  error
fct_weather              session_key                  not_null  error
fct_weather              recorded_at                  not_null  error
fct_race_control         session_key                  not_null  error
fct_race_control         recorded_at                  not_null  error
fct_race_control         message                      not_null  error
fct_car_data             session_key                  not_null  error
fct_car_data             driver_number                not_null  error
fct_car_data             recorded_at                  not_null  error
fct_location             session_key                  not_null  error
fct_location             driver_number                not_null  error
fct_location             recorded_at                  not_null  error
dim_championship_drivers driver_number                not_null  error
dim_championship_drivers session_key                  not_null  error
dim_championship_drivers championship_position        not_null  error
dim_championship_teams   team_name                    not_null  error
dim_championship_teams   session_key                  not_null  error
dim_championship_teams   championship_position        not_null  error
stg_meetings             meeting_key                  not_null  error
stg_meetings             meeting_key                  unique    error
stg_championship_drivers driver_number                not_null  error
stg_championship_drivers session_key                  not_null  error
stg_championship_teams   team_name                    not_null  error
stg_championship_teams   session_key                  not_null  error
stg_sessions             session_key                  not_null  error
stg_sessions             session_key                  unique    error
"""
CHECKS = [tuple(line.split()) for line in TEXT.strip().splitlines()]
