"""Staging (M1-M18): typed projection of RAW VARIANT records, row filters on
raw paths, then latest-per-key (newest ``loaded_at``).

Filters run before the dedupe (WHERE precedes QUALIFY): a newer record with a
null lap duration must not shadow an older valid lap. Ties on ``loaded_at``
are broken by a hash of the raw record, so the choice is deterministic.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from pitwall.functions.variant import Field, Require, VariantSpec, project_variant
from pitwall.operators.dedupe import latest_per_key, row_hash


@dataclass(frozen=True)
class StagingModel:
    endpoint: str
    spec: VariantSpec
    keys: tuple[str, ...]
    with_year: bool = False      # add season year from staged sessions


def _f(*triples) -> tuple[Field, ...]:
    return tuple(Field(o, p, k) for o, p, k in triples)


SK, DN, DATE = ("session_key", "session_key", "int"), ("driver_number", "driver_number", "int"), \
    ("recorded_at", "date", "timestamp_ntz")

MODELS: dict[str, StagingModel] = {
    "stg_car_data": StagingModel("car_data", VariantSpec(_f(
        SK, DN, ("speed_kmh", "speed", "int"), ("throttle_pct", "throttle", "int"),
        ("is_braking", "brake", "flag"), ("drs_status", "drs", "int"), ("gear", "n_gear", "int"),
        ("rpm", "rpm", "int"), DATE)), ("session_key", "driver_number", "recorded_at")),
    "stg_championship_drivers": StagingModel("championship_drivers", VariantSpec(_f(
        SK, ("meeting_key", "meeting_key", "int"), DN, ("points_current", "points_current", "double"),
        ("points_start", "points_start", "double"), ("championship_position", "position_current", "int"),
        ("championship_position_start", "position_start", "int")),
        (Require("driver_number"), Require("session_key"))), ("session_key", "driver_number"), True),
    "stg_championship_teams": StagingModel("championship_teams", VariantSpec(_f(
        SK, ("meeting_key", "meeting_key", "int"), ("team_name", "team_name", "string"),
        ("points_current", "points_current", "double"), ("points_start", "points_start", "double"),
        ("championship_position", "position_current", "int"),
        ("championship_position_start", "position_start", "int")),
        (Require("team_name", nonempty=True), Require("session_key"))), ("session_key", "team_name"), True),
    "stg_drivers": StagingModel("drivers", VariantSpec(_f(
        SK, DN, ("broadcast_name", "broadcast_name", "string"), ("full_name", "full_name", "string"),
        ("acronym", "name_acronym", "string"), ("team_name", "team_name", "string"),
        ("team_colour", "team_colour", "string"), ("country_code", "country_code", "string"),
        ("headshot_url", "headshot_url", "string"))), ("session_key", "driver_number")),
    "stg_intervals": StagingModel("intervals", VariantSpec(_f(
        SK, DN, ("gap_to_leader_s", "gap_to_leader", "try_double"),
        ("interval_to_ahead_s", "interval", "try_double"), DATE)), ("session_key", "driver_number", "recorded_at")),
    "stg_laps": StagingModel("laps", VariantSpec(_f(
        SK, DN, ("lap_number", "lap_number", "int"), ("lap_duration_s", "lap_duration", "double"),
        ("sector_1_s", "duration_sector_1", "double"), ("sector_2_s", "duration_sector_2", "double"),
        ("sector_3_s", "duration_sector_3", "double"), ("speed_trap_i1_kmh", "i1_speed", "double"),
        ("speed_trap_i2_kmh", "i2_speed", "double"), ("speed_trap_fl_kmh", "st_speed", "double"),
        ("is_pit_out_lap", "is_pit_out_lap", "boolean"), ("lap_start_at", "date_start", "timestamp_ntz")),
        (Require("lap_duration", typed="double"),)), ("session_key", "driver_number", "lap_number")),
    "stg_location": StagingModel("location", VariantSpec(_f(
        SK, DN, ("pos_x", "x", "double"), ("pos_y", "y", "double"), ("pos_z", "z", "double"), DATE)),
        ("session_key", "driver_number", "recorded_at")),
    "stg_meetings": StagingModel("meetings", VariantSpec(_f(
        ("meeting_key", "meeting_key", "int"), ("meeting_name", "meeting_name", "string"),
        ("meeting_official_name", "meeting_official_name", "string"), ("circuit_key", "circuit_key", "int"),
        ("circuit_short_name", "circuit_short_name", "string"), ("country_name", "country_name", "string"),
        ("location", "location", "string"), ("year", "year", "int"),
        ("meeting_start_at", "date_start", "timestamp_ntz"))), ("meeting_key",)),
    "stg_overtakes": StagingModel("overtakes", VariantSpec(_f(
        SK, ("driver_overtaking", "overtaking_driver_number", "int"),
        ("driver_overtaken", "overtaken_driver_number", "int"), ("lap_number", "lap_number", "int"), DATE)),
        ("session_key", "driver_overtaking", "driver_overtaken", "recorded_at")),
    "stg_pit": StagingModel("pit", VariantSpec(_f(
        SK, DN, ("lap_number", "lap_number", "int"), ("pit_duration_s", "pit_duration", "double"),
        ("pit_at", "date", "timestamp_ntz"))), ("session_key", "driver_number", "lap_number")),
    "stg_position": StagingModel("position", VariantSpec(_f(
        SK, DN, ("position", "position", "int"), DATE)), ("session_key", "driver_number", "recorded_at")),
    "stg_race_control": StagingModel("race_control", VariantSpec(_f(
        SK, DN, ("category", "category", "string"), ("flag", "flag", "string"),
        ("lap_number", "lap_number", "int"), ("message", "message", "string"), ("scope", "scope", "string"),
        ("sector", "sector", "int"), DATE)), ("session_key", "recorded_at", "message")),
    "stg_session_result": StagingModel("session_result", VariantSpec(_f(
        SK, DN, ("finish_position", "position", "int"), ("points", "points", "as_double"),
        ("classified_position", "classified_position", "string"), ("is_dnf", "dnf", "boolean"),
        ("is_dns", "dns", "boolean"), ("is_dsq", "dsq", "boolean"), ("laps_completed", "number_of_laps", "int"),
        ("race_duration_s", "duration", "as_double"), ("gap_to_leader", "gap_to_leader", "string"))),
        ("session_key", "driver_number")),
    "stg_sessions": StagingModel("sessions", VariantSpec(_f(
        SK, ("session_name", "session_name", "string"), ("session_type", "session_type", "string"),
        ("meeting_key", "meeting_key", "int"), ("circuit_key", "circuit_key", "int"),
        ("circuit_short_name", "circuit_short_name", "string"), ("country_name", "country_name", "string"),
        ("location", "location", "string"), ("year", "year", "int"),
        ("session_start_at", "date_start", "timestamp_ntz"), ("session_end_at", "date_end", "timestamp_ntz"))),
        ("session_key",)),
    "stg_starting_grid": StagingModel("starting_grid", VariantSpec(_f(
        SK, ("meeting_key", "meeting_key", "int"), DN, ("grid_position", "position", "int"))),
        ("session_key", "driver_number")),
    "stg_stints": StagingModel("stints", VariantSpec(_f(
        SK, DN, ("stint_number", "stint_number", "int"), ("lap_start", "lap_start", "int"),
        ("lap_end", "lap_end", "int"), ("tyre_compound", "compound", "string"),
        ("tyre_age_at_start", "tyre_age_at_start", "int")),
        (Require("session_key"), Require("driver_number"), Require("compound", present=False, typed="string"))),
        ("session_key", "driver_number", "stint_number")),
    "stg_team_radio": StagingModel("team_radio", VariantSpec(_f(
        SK, DN, ("recording_url", "recording_url", "string"), DATE)),
        ("session_key", "driver_number", "recorded_at")),
    "stg_weather": StagingModel("weather", VariantSpec(_f(
        SK, ("air_temp_c", "air_temperature", "double"), ("track_temp_c", "track_temperature", "double"),
        ("humidity_pct", "humidity", "double"), ("pressure_mbar", "pressure", "double"),
        ("wind_speed_ms", "wind_speed", "double"), ("wind_direction_deg", "wind_direction", "int"),
        ("is_raining", "rainfall", "flag"), DATE)), ("session_key", "recorded_at")),
}


def stage(raw: DataFrame, model: StagingModel, sessions: DataFrame | None = None) -> DataFrame:
    """Run one staging model over a RAW DataFrame."""
    typed = project_variant(raw, model.spec, keep=("loaded_at",))
    # Tiebreak on equal loaded_at: a hash of the typed row. Records that tie on
    # every projected column yield the same output row, so this is as
    # deterministic as hashing the raw text and much cheaper than to_json.
    out = latest_per_key(typed, model.keys, tiebreak=[row_hash(typed, exclude=("loaded_at",)).desc()])
    if model.with_year:
        if sessions is None:
            raise ValueError(f"{model.endpoint} needs staged sessions for the season year")
        cols = [c for c in out.columns if c != "loaded_at"]
        out = out.join(sessions.select("session_key", "year"), ["session_key"], "left") \
                 .select(*cols, "year", "loaded_at")
    return out


def build_staging(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All staging models from RAW tables keyed by endpoint name (lazy)."""
    out: dict[str, DataFrame] = {}
    out["stg_sessions"] = stage(raw["sessions"], MODELS["stg_sessions"])
    for name, model in MODELS.items():
        if name in out or model.endpoint not in raw:
            continue
        out[name] = stage(raw[model.endpoint], model, out["stg_sessions"])
    return out
