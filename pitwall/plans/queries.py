"""Query catalogue: dashboard / context queries (Q1-Q27) and the semantic
model's verified queries (V1-V16), over the marts.

Parameters replace the source's clock and string interpolation: ``season``
(the source's YEAR(CURRENT_DATE())) and ``as_of`` (CURRENT_TIMESTAMP) are
explicit so results are reproducible. Queries the dashboard ran for one
session or meeting take an optional key; without it they run for every key
at once (grouped), which is how they are registered.

"Last race" is MAX(session_key) (key order = time order, as in the source).
Top-k queries keep their LIMIT: there the limit is the feature, and a total
order makes the cut deterministic.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwall.functions import scalars as S
from pitwall.operators.dedupe import keep_first
from pitwall.operators.joins import asof_join, locate, range_join
from pitwall.operators.timeseries import (argmax_per_point, gap_fill_linear, last_non_null, resample_linear,
                                          segments, seq_index)
from pitwall.plans.marts import Marts, clean_laps, exact_avg
from pitwall.session import materialize

SEASON = 2024
AS_OF = dt.datetime(2024, 6, 1)


def _lit_ts(ts: dt.datetime) -> Column:
    """Wall-clock literal, independent of the session and process time zones."""
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def _key(df: DataFrame, col: str, value) -> DataFrame:
    return df if value is None else df.where(F.col(col) == F.lit(value))


def _first(df: DataFrame, top: int | None) -> DataFrame:
    """All rows, or the first ``top`` for a caller that asks for so many."""
    return df if top is None else df.limit(top)


def _races(m: Marts, name: str = "Race", stype: str | None = "Race") -> DataFrame:
    s = m.dim_sessions.where(F.col("session_name") == name)
    return s if stype is None else s.where(F.col("session_type") == stype)


def _winners(m: Marts) -> DataFrame:
    return m.fct_session_results.where(F.col("finish_position") == 1)


# ------------------------------------------------------------------ calendar / race page
def seasons(m: Marts) -> DataFrame:
    """Q1."""
    return m.dim_sessions.select("year").distinct().orderBy(F.col("year").desc())


def season_calendar(m: Marts, season: int | None = None, as_of: dt.datetime = AS_OF) -> DataFrame:
    """Q2: one row per meeting (first race session), round number, winner, status.

    The round number is a RANK over the season's race sessions: computed on
    the session dimension only, partitioned by season.
    """
    rs = _key(_races(m), "year", season)
    rs = (rs.withColumn("rn", F.row_number().over(Window.partitionBy("meeting_key").orderBy(
                        "session_start_at", "session_key")))
          .withColumn("round_num", F.rank().over(Window.partitionBy("year").orderBy("session_start_at"))))
    w = _winners(m).select("session_key", F.col("driver_name").alias("winner_name"),
                           F.col("team_name").alias("winner_team"))
    out = rs.where("rn = 1").join(w, ["session_key"], "left")
    return out.select("year", "session_key", "meeting_key", "meeting_name", "circuit_short_name", "country_name",
                      "session_start_at", "round_num", "winner_name", "winner_team",
                      S.race_status(F.col("winner_name"), F.col("session_start_at"), _lit_ts(as_of)).alias("status"),
                      S.format_date("session_start_at").alias("date_label"))


def meeting_sessions(m: Marts, meeting_key: int | None = None) -> DataFrame:
    """Q3."""
    return _key(m.dim_sessions, "meeting_key", meeting_key).select(
        "meeting_key", "session_key", "session_name", "session_start_at", "meeting_name", "year")


def winner_hero(m: Marts, session_key: int | None = None) -> DataFrame:
    """Q4: conditional pick of the winner per session."""
    r = _key(m.fct_session_results, "session_key", session_key)
    first = F.col("finish_position") == 1
    return r.groupBy("session_key").agg(F.max(F.when(first, F.col("driver_name"))).alias("race_winner"),
                                        F.max(F.when(first, F.col("team_name"))).alias("winner_team"))


def fastest_lap(m: Marts, session_key: int | None = None) -> DataFrame:
    """Q5: fastest driver per session (ties → driver name)."""
    lp = _key(m.fct_laps, "session_key", session_key)
    per = lp.groupBy("session_key", "driver_name").agg(F.min("lap_duration_s").alias("fl"))
    return keep_first(per, ["session_key"], [F.col("fl").asc_nulls_last(), F.col("driver_name").asc_nulls_last()])


def pole_sitter(m: Marts, session_key: int | None = None) -> DataFrame:
    """Q6: driver on grid position 1 (the source's unordered LIMIT 1 → smallest name)."""
    r = _key(m.fct_session_results, "session_key", session_key).where(F.col("grid_position") == 1)
    return r.groupBy("session_key").agg(F.min("driver_name").alias("driver_name"))


def session_results(m: Marts, session_key: int | None = None) -> DataFrame:
    """Q7: results table with display columns."""
    r = _key(m.fct_session_results, "session_key", session_key)
    return r.select("session_key", "finish_position", "driver_name", "driver_acronym", "team_name",
                    "grid_position", "classified_position", "points",
                    S.int_or_dash("finish_position").alias("pos_label"),
                    S.int_or_dash("grid_position").alias("grid_label"),
                    F.coalesce("classified_position", F.lit(S.CLASS_OK)).alias("status"),
                    S.points_int("points").alias("pts"))


# ------------------------------------------------------------------ positions page
def lap_intervals(m: Marts, session_key: int | None = None, whole_seconds: bool = False) -> DataFrame:
    """Q8: lap start / end instants (end = start + fractional duration)."""
    lp = _key(m.fct_laps, "session_key", session_key)
    return lp.select("session_key", "driver_number", "lap_number", "lap_start_at",
                     S.add_seconds("lap_start_at", "lap_duration_s", whole_seconds).alias("lap_end_at"))


POS_COLS = ["driver_name", "driver_acronym", "team_name", "position", "recorded_at", "grid_position",
            "finish_position", "positions_gained"]


def positions_per_lap(m: Marts, session_key: int | None = None, whole_seconds: bool = False) -> DataFrame:
    """Q9: each position sample mapped to the lap containing it (closed
    interval, lowest lap on a shared boundary, unmatched dropped), then the
    last non-null value of every column per (driver, lap); sessions without
    laps number the samples per driver instead. ``total_laps`` per session."""
    pos = _key(m.fct_race_positions, "session_key", session_key)
    laps = lap_intervals(m, session_key, whole_seconds)
    inst = pos.select("session_key", "driver_number", "recorded_at").distinct()
    located = locate(inst, laps, ["session_key", "driver_number"], "recorded_at", "lap_start_at", "lap_end_at",
                     order=[F.col("lap_number").asc()]).select("session_key", "driver_number", "recorded_at",
                                                              F.col("lap_number").alias("lap"))
    with_laps = pos.join(located, ["session_key", "driver_number", "recorded_at"], "inner")
    order = F.struct(F.col("recorded_at"), F.col("grid_position"))
    agg = last_non_null(with_laps, ["session_key", "driver_number", "lap"], order, POS_COLS)
    no_laps = pos.join(laps.select("session_key").distinct(), ["session_key"], "left_anti")
    counted = seq_index(no_laps, ["session_key", "driver_number"], [F.col("recorded_at"), F.col("grid_position")],
                        "lap", bucket=("recorded_at", 3600.0)).withColumn("lap", F.col("lap").cast("int")).select("session_key", "driver_number", "lap", *POS_COLS)
    out = agg.unionByName(counted)
    total = out.groupBy("session_key").agg(F.max("lap").alias("total_laps"))
    return out.join(total, ["session_key"], "left")


def grid_summary(m: Marts, session_key: int | None = None) -> DataFrame:
    """Q10: grid vs finish with unconditional places gained and trend arrow."""
    r = _key(m.fct_session_results, "session_key", session_key)
    g = F.col("finish_position") - F.col("grid_position")
    return r.select("session_key", "driver_name", "driver_acronym", "team_name", "grid_position", "finish_position",
                    "classified_position", g.alias("positions_gained"), S.trend_arrow(g).alias("trend"))


def race_control_timeline(m: Marts, session_key: int | None = None, categories: Sequence[str] | None = None,
                          flags: Sequence[str] | None = None) -> DataFrame:
    """Q11: normalised flags/categories; keep category ∈ set ∧ (flag ∈ set ∨ flag = '')."""
    rc = _key(m.fct_race_control, "session_key", session_key)
    rc = rc.withColumn("flag", S.normalise("flag")).withColumn("category", F.trim(F.coalesce("category", F.lit(""))))
    cond = F.lit(True)
    if categories is not None:
        cond = cond & F.col("category").isin(list(categories))
    if flags is not None:
        cond = cond & (F.col("flag").isin(list(flags)) | (F.col("flag") == ""))
    return rc.withColumn("shown", cond).orderBy("session_key", "recorded_at", "message")


def race_control_counts(m: Marts, categories=("Flag", "SafetyCar"), flags=("YELLOW", "RED")) -> DataFrame:
    """Q11 "n of total" per session (an aggregate, no global window)."""
    rc = race_control_timeline(m, None, categories, flags)
    return rc.groupBy("session_key").agg(F.count_if(F.col("shown")).alias("n_shown"),
                                         F.count(F.lit(1)).alias("n_total"))


# ------------------------------------------------------------------ strategy page
def race_key_for(m: Marts, session_key: int | None = None) -> DataFrame:
    """The meeting's race session, else the session itself."""
    s = _key(m.dim_sessions, "session_key", session_key).select("session_key", "meeting_key")
    races = _races(m).select(F.col("session_key").alias("rk"), "meeting_key")
    j = s.join(races, ["meeting_key"], "left").groupBy("session_key").agg(F.min("rk").alias("rk"))
    return j.select("session_key", F.coalesce("rk", "session_key").alias("race_key"))


def stint_strategy(m: Marts, race_key: int | None = None) -> DataFrame:
    """Q13/Q14: stints with finish position (joined on driver number, not the
    acronym, so a repeated acronym cannot fan out), driver label and bar geometry."""
    st = _key(m.fct_stints, "session_key", race_key)
    fin = m.fct_session_results.select("session_key", "driver_number", "finish_position")
    st = st.join(fin, ["session_key", "driver_number"], "left")
    length = F.when(F.col("lap_end").isNotNull(), F.col("lap_end") - F.col("lap_start") + 1).otherwise(
        F.col("stint_length"))
    return st.select("session_key", "driver_number", "driver_acronym", "stint_number",
                     F.upper(F.coalesce("tyre_compound", F.lit("HARD"))).alias("tyre_compound"),
                     "lap_start", "lap_end", "stint_length", "finish_position",
                     S.driver_label("finish_position", "driver_acronym").alias("label"),
                     (F.col("lap_start") - 1).alias("bar_base"), length.alias("bar_length"))


def driver_order(m: Marts, race_key: int | None = None) -> DataFrame:
    """Distinct (driver, finish) pairs per race in finishing order (unknown last)."""
    st = stint_strategy(m, race_key).select("session_key", "driver_acronym", "finish_position").dropDuplicates()
    w = Window.partitionBy("session_key").orderBy(F.col("finish_position").asc_nulls_last(),
                                                  F.col("driver_acronym").asc_nulls_last())
    return st.withColumn("order_idx", F.row_number().over(w))


def stint_detail(m: Marts, race_key: int | None = None) -> DataFrame:
    """Q15: formatted stint table (lap times m:ss.mmm, signed degradation)."""
    st = _key(m.fct_stints, "session_key", race_key)
    fin = m.fct_session_results.select("session_key", "driver_number", "finish_position")
    st = st.join(fin, ["session_key", "driver_number"], "left")
    return st.select("session_key", "driver_acronym", "finish_position", "stint_number",
                     F.upper(F.coalesce("tyre_compound", F.lit("HARD"))).alias("compound"),
                     S.lap_span("stint_length", "lap_start", "lap_end").alias("laps"),
                     S.format_laptime(F.round(F.col("fastest_lap_s"), 3)).alias("best"),
                     S.format_laptime(F.round(F.col("avg_lap_time_s"), 3)).alias("avg"),
                     F.when(F.col("gap_to_best_s").isNull(), F.lit(S.DASH)).otherwise(
                         F.format_string("%.3f", F.round(F.col("gap_to_best_s"), 3))).alias("gap"),
                     S.format_delta("deg_per_lap_s").alias("deg_per_lap"))


# ------------------------------------------------------------------ lap times / track dominance
def _laps_with_drivers(m: Marts, session_key: int | None) -> DataFrame:
    lp = _key(m.fct_laps, "session_key", session_key).where(F.col("lap_duration_s").isNotNull())
    d = m.dim_drivers.select("session_key", "driver_number", F.col("acronym").alias("driver_acronym"),
                             F.col("full_name").alias("driver_name"), "team_name")
    return lp.select("session_key", "driver_number", "lap_number", "lap_duration_s", "is_pit_out_lap",
                     "lap_start_at").join(d, ["session_key", "driver_number"], "inner")


def lap_times(m: Marts, session_key: int | None = None, clean_only: bool = False) -> DataFrame:
    """Q16."""
    lp = _laps_with_drivers(m, session_key)
    if clean_only:
        lp = clean_laps(lp)
    return lp.select("session_key", "lap_number", "lap_duration_s", "is_pit_out_lap", "driver_acronym",
                     "driver_name", "team_name")


def clean_laps_with_end(m: Marts, session_key: int | None = None, whole_seconds: bool = False) -> DataFrame:
    """Q17: clean laps with their end instant."""
    lp = clean_laps(_laps_with_drivers(m, session_key))
    return lp.select("session_key", "driver_number", "lap_number", "lap_duration_s", "lap_start_at",
                     S.add_seconds("lap_start_at", "lap_duration_s", whole_seconds).alias("lap_end_at"),
                     "driver_acronym", "driver_name", "team_name")


TEL_COLS = ["recorded_at", "speed_kmh", "gear", "throttle_pct", "is_braking", "drs_status", "rpm"]


def lap_telemetry(m: Marts, session_key: int | None = None, laps: DataFrame | None = None,
                  whole_seconds: bool = False) -> DataFrame:
    """Q18: car samples inside each clean lap ``[start, end)`` with the
    location as-of each sample (latest location at or before it), plus the
    sample ordinal inside the lap as distance axis.

    Car samples are first range-joined to the laps (so only samples of
    requested laps reach the as-of join); location is reduced to the
    (session, driver) pairs involved but not by time, since a location
    before the lap start can still be the match."""
    lp = (laps if laps is not None else clean_laps_with_end(m, session_key, whole_seconds)).select(
        "session_key", "driver_number", "lap_number", "lap_start_at", "lap_end_at")
    car = _key(m.fct_car_data, "session_key", session_key).select("session_key", "driver_number", *TEL_COLS)
    car = range_join(car, lp, ["session_key", "driver_number"], "recorded_at", "lap_start_at", "lap_end_at",
                     how="inner", hi_inclusive=False).drop("lap_start_at", "lap_end_at")
    loc = _key(m.fct_location, "session_key", session_key).select(
        "session_key", "driver_number", F.col("recorded_at").alias("loc_at"), "pos_x", "pos_y", "pos_z")
    loc = loc.join(lp.select("session_key", "driver_number").distinct(), ["session_key", "driver_number"], "left_semi")
    tel = asof_join(car, loc, ["session_key", "driver_number"], "recorded_at", "loc_at").drop("loc_at")
    tel = seq_index(tel, ["session_key", "driver_number", "lap_number"], [F.col("recorded_at")], "dist", 0,
                    bounded=True)
    return tel.select("session_key", "driver_number", "lap_number", "dist", *TEL_COLS, "pos_x", "pos_y", "pos_z")


def fastest_clean_laps(m: Marts, session_key: int | None = None, whole_seconds: bool = False) -> DataFrame:
    """Each driver's fastest clean lap (ties → lower lap number)."""
    lp = clean_laps_with_end(m, session_key, whole_seconds)
    best = lp.groupBy("session_key", "driver_number").agg(
        F.min_by("lap_number", F.struct("lap_duration_s", "lap_number")).alias("lap_number"))
    return lp.join(best, ["session_key", "driver_number", "lap_number"], "left_semi")


def track_dominance(m: Marts, session_key: int | None = None, whole_seconds: bool = False) -> DataFrame:
    """Q19: every driver's fastest clean lap is a series; the grid is the
    first series' (smallest acronym) non-null positions; each series' speed
    (NULL → 0) is resampled onto that many points; the fastest series wins
    each point (first series on ties) and colours the segment to the next point."""
    combos = fastest_clean_laps(m, session_key, whole_seconds)
    tel = lap_telemetry(m, session_key, combos)
    series = combos.select("session_key", "driver_number", "lap_number", "driver_acronym")
    # the selected laps' telemetry feeds five branches below: written once as a
    # table in the shared folder (size statistics and column pruning stay)
    tel = materialize(tel.join(series, ["session_key", "driver_number", "lap_number"], "inner"), "dominance_telemetry")
    first = keep_first(series, ["session_key"], [F.col("driver_acronym").asc(), F.col("driver_number").asc()])
    grid_pts = (tel.join(first.select("session_key", "driver_number", "lap_number"),
                         ["session_key", "driver_number", "lap_number"], "left_semi")
                .where(F.col("pos_x").isNotNull() & F.col("pos_y").isNotNull()))
    grid_pts = seq_index(grid_pts, ["session_key"], [F.col("dist")], "point", 0, bounded=True)     # one lap
    n = grid_pts.groupBy("session_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    samples = tel.join(n, ["session_key"], "inner")
    res = resample_linear(samples, ["session_key", "driver_number", "driver_acronym"], [F.col("dist")],
                          "speed_kmh", "n", null_as=0.0, point="point", bucket=("dist", 256))
    win = argmax_per_point(res, ["session_key", "point"], "speed_kmh",
                           [F.col("driver_acronym").asc(), F.col("driver_number").asc()])
    seg = segments(grid_pts.select("session_key", "point", F.col("pos_x").alias("x"), F.col("pos_y").alias("y")),
                   ["session_key"], "point", "x", "y")
    return seg.join(win.select("session_key", "point", F.col("driver_acronym").alias("winner"),
                               F.col("speed_kmh").alias("winner_speed")), ["session_key", "point"], "left")


def race_positions_strict(m: Marts) -> DataFrame:
    """M31 with the earliest-grid rule (no fan-out over two qualifying sessions)."""
    return Marts(m.stg, strict_grid=True).fct_race_positions


def track_map(m: Marts, session_key: int | None = None, rotation_deg: float = 30.0) -> DataFrame:
    """Track outline from each driver's fastest clean lap: location X/Y along
    the lap, gaps filled linearly (leading gaps dropped), rotated by
    ``-rotation_deg`` (W10 + F19 re-aimed from the external circuit map)."""
    tel = lap_telemetry(m, session_key, fastest_clean_laps(m, session_key)).select(
        "session_key", "driver_number", "lap_number", "dist", "pos_x", "pos_y")
    filled = gap_fill_linear(tel, ["session_key", "driver_number", "lap_number"], [F.col("dist")], ["pos_x", "pos_y"],
                             bucket=("dist", 4096))
    x, y = S.rotate2d(F.col("pos_x"), F.col("pos_y"), rotation_deg)
    return filled.select("session_key", "driver_number", "lap_number", "dist",
                         F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def session_meta(m: Marts, session_key: int | None = None) -> DataFrame:
    """Q20."""
    return _key(m.dim_sessions, "session_key", session_key).select("session_key", "year", "meeting_name")


# ------------------------------------------------------------------ assistant context queries
def _last_races(m: Marts, k: int, season: int | None, as_of: dt.datetime) -> DataFrame:
    """The k most recent race sessions before ``as_of`` (distributed top-k)."""
    r = _races(m).where(F.col("session_start_at") < _lit_ts(as_of))
    r = _key(r, "year", season)
    return r.orderBy(F.col("session_start_at").desc(), F.col("session_key").desc()).limit(k)


def recent_results(m: Marts, k: int = 3, season: int | None = None, as_of: dt.datetime = AS_OF,
                   with_grid: bool = False) -> DataFrame:
    """Q21 (k races, all seasons) / Q24 (k races of a season, with grid): every
    result row of the k most recent races, newest race first."""
    races = _last_races(m, k, season, as_of).select("session_key", "meeting_name", "country_name", "session_start_at")
    r = m.fct_session_results.join(races, ["session_key"], "inner")
    cols = ["driver_name", "team_name", "finish_position", "points"] + (["grid_position"] if with_grid else [])
    return r.orderBy(F.col("session_start_at").desc(), F.col("session_key").desc(),
                     F.col("finish_position").asc_nulls_last(), "driver_number").select(
        *cols, "meeting_name", "country_name", "session_start_at")


def driver_standings(m: Marts, season: int = SEASON, top: int | None = None) -> DataFrame:
    """V4 / Q22: standings at the season's latest championship session."""
    cd = m.dim_championship_drivers.where(F.col("year") == season)
    latest = cd.agg(F.max("session_key").alias("session_key"))
    cd = cd.join(latest, ["session_key"], "left_semi")
    d = m.dim_drivers.select("session_key", "driver_number", "full_name", "team_name")
    out = cd.join(d, ["session_key", "driver_number"], "inner").select(
        "full_name", "championship_position", "points_current", "team_name")
    return _first(out.orderBy(F.col("championship_position").asc_nulls_last(), F.col("full_name")), top)


def next_race(m: Marts, as_of: dt.datetime = AS_OF) -> DataFrame:
    """Q23."""
    r = _races(m).where(F.col("session_start_at") > _lit_ts(as_of))
    return r.orderBy("session_start_at", "session_key").limit(1).select(
        "meeting_name", "country_name", "circuit_short_name", "session_start_at")


def season_lap_pace(m: Marts, season: int = SEASON, top: int | None = None) -> DataFrame:
    """Q25."""
    lp = m.fct_laps.where(F.col("lap_duration_s").isNotNull()).join(
        m.dim_sessions.where(F.col("year") == season).select("session_key"), ["session_key"], "left_semi")
    agg = lp.groupBy("driver_name", "team_name").agg(F.round(exact_avg(F.col("lap_duration_s")), 3).alias("avg_lap_s"),
                                                     F.round(F.min("lap_duration_s"), 3).alias("best_lap_s"),
                                                     F.count(F.lit(1)).alias("total_laps"))
    return _first(agg.orderBy(F.col("avg_lap_s").asc_nulls_last(), "driver_name", "team_name"), top)


def season_pit_performance(m: Marts, season: int = SEASON, top: int | None = None) -> DataFrame:
    """Q26."""
    p = m.fct_pit_stops.where(F.col("pit_duration_s").isNotNull()).join(
        m.dim_sessions.where(F.col("year") == season).select("session_key"), ["session_key"], "left_semi")
    agg = p.groupBy("driver_name", "team_name").agg(F.round(exact_avg(F.col("pit_duration_s")), 2).alias("avg_pit_s"),
                                                    F.count(F.lit(1)).alias("total_stops"))
    return _first(agg.orderBy(F.col("avg_pit_s").asc_nulls_last(), "driver_name", "team_name"), top)


def season_compounds(m: Marts, season: int = SEASON, top: int | None = None) -> DataFrame:
    """Q27: stints per driver and compound."""
    st = m.fct_stints.join(m.dim_sessions.where(F.col("year") == season).select("session_key"),
                           ["session_key"], "left_semi")
    agg = st.groupBy("driver_name", "tyre_compound").agg(F.count(F.lit(1)).alias("stints"))
    return _first(agg.orderBy(F.col("driver_name").asc_nulls_last(), F.col("stints").desc(),
                              F.col("tyre_compound").asc_nulls_last()), top)


def remaining_races(m: Marts, season: int = SEASON, as_of: dt.datetime = AS_OF) -> DataFrame:
    """Q27 (A8)."""
    r = _races(m).where((F.col("year") == season) & (F.col("session_start_at") > _lit_ts(as_of)))
    return r.agg(F.count(F.lit(1)).alias("remaining_races"))


# ------------------------------------------------------------------ verified queries
def _season_races(m: Marts, season: int, name="Race", stype="Race") -> DataFrame:
    return _races(m, name, stype).where(F.col("year") == season)


def v_races_happened(m: Marts, season: int = SEASON) -> DataFrame:
    s = _season_races(m, season)
    r = _winners(m).select("session_key", F.col("driver_name").alias("winner"))
    return s.join(r, ["session_key"], "inner").select("meeting_name", "country_name", "circuit_short_name",
                                                      "session_start_at", "winner").orderBy("session_start_at",
                                                                                            "winner")


def v_race_count(m: Marts, season: int = SEASON, as_of: dt.datetime = AS_OF) -> DataFrame:
    s = _season_races(m, season).where(F.col("session_start_at") < _lit_ts(as_of))
    r = _winners(m).select("session_key", "finish_position")
    j = s.join(r, ["session_key"], "left")
    return j.agg(F.count(F.when(F.col("finish_position") == 1, 1)).alias("races_completed"),
                 F.count(F.when(F.col("finish_position").isNull() & (F.col("session_start_at") < _lit_ts(as_of)),
                                1)).alias("races_cancelled"),
                 F.count(F.lit(1)).alias("races_scheduled"))


def v_race_winners(m: Marts, season: int = SEASON, as_of: dt.datetime = AS_OF) -> DataFrame:
    s = _season_races(m, season).where(F.col("session_start_at") < _lit_ts(as_of))
    return _winners(m).join(s.select("session_key", "meeting_name", "country_name", "session_start_at"),
                            ["session_key"], "inner").select("meeting_name", "country_name", "driver_name",
                                                             "team_name", "points", "session_start_at") \
        .orderBy("session_start_at", "driver_name")


def _latest_race_before(m: Marts, as_of: dt.datetime) -> DataFrame:
    return _races(m).where(F.col("session_start_at") < _lit_ts(as_of)).agg(F.max("session_key").alias("session_key"))


def _latest_race_with_winner(m: Marts) -> DataFrame:
    return _races(m).join(_winners(m).select("session_key"), ["session_key"], "left_semi") \
        .agg(F.max("session_key").alias("session_key"))


def v_fastest_laps_last_race(m: Marts, as_of: dt.datetime = AS_OF) -> DataFrame:
    lp = m.fct_laps.join(_latest_race_before(m, as_of), ["session_key"], "left_semi")
    return lp.groupBy("driver_name", "driver_acronym", "team_name").agg(F.min("lap_duration_s").alias("fastest_lap_s")) \
        .orderBy(F.col("fastest_lap_s").asc_nulls_last(), "driver_name")


def v_pit_stop_performance(m: Marts, season: int = SEASON) -> DataFrame:
    s = m.dim_sessions.where((F.col("year") == season) & (F.col("session_type") == "Race")).select("session_key")
    p = m.fct_pit_stops.where(F.col("pit_duration_s").isNotNull()).join(s, ["session_key"], "left_semi")
    return p.groupBy("team_name").agg(F.round(exact_avg(F.col("pit_duration_s")), 3).alias("avg_pit_s"),
                                      F.count(F.lit(1)).alias("pit_count")) \
        .orderBy(F.col("avg_pit_s").asc_nulls_last(), "team_name")


def v_cancelled_races(m: Marts, season: int = SEASON, as_of: dt.datetime = AS_OF) -> DataFrame:
    s = _season_races(m, season).where(F.col("session_start_at") < _lit_ts(as_of))
    return s.join(_winners(m).select("session_key"), ["session_key"], "left_anti").select(
        "meeting_name", "country_name", "circuit_short_name", "session_start_at").orderBy("session_start_at")


def v_upcoming_races(m: Marts, season: int = SEASON, as_of: dt.datetime = AS_OF) -> DataFrame:
    s = _season_races(m, season).where(F.col("session_start_at") > _lit_ts(as_of))
    return s.select("meeting_name", "country_name", "circuit_short_name", "session_start_at") \
        .orderBy("session_start_at")


def v_constructor_standings(m: Marts, season: int = SEASON) -> DataFrame:
    ct = m.dim_championship_teams.where(F.col("year") == season)
    latest = ct.agg(F.max("session_key").alias("session_key"))
    return ct.join(latest, ["session_key"], "left_semi").select(
        "team_name", "championship_position", "points_current").orderBy(
        F.col("championship_position").asc_nulls_last(), "team_name")


def v_driver_wins(m: Marts, season: int = SEASON) -> DataFrame:
    s = _season_races(m, season).select("session_key")
    return _winners(m).join(s, ["session_key"], "left_semi").groupBy("driver_name", "team_name").agg(
        F.count(F.lit(1)).alias("wins")).orderBy(F.col("wins").desc(), "driver_name", "team_name")


def v_tyre_strategy_last_race(m: Marts) -> DataFrame:
    st = m.fct_stints.join(_latest_race_with_winner(m), ["session_key"], "left_semi")
    return st.select("driver_name", "driver_acronym", "stint_number", "tyre_compound", "lap_start", "lap_end",
                     "stint_length").orderBy("driver_name", "stint_number")


def v_pole_positions(m: Marts, season: int = SEASON) -> DataFrame:
    s = _season_races(m, season, "Qualifying", "Qualifying").select(
        "session_key", "meeting_name", "country_name", "session_start_at")
    return _winners(m).join(s, ["session_key"], "inner").orderBy("session_start_at", "driver_name").select(
        "meeting_name", "country_name", "driver_name", "team_name")


def v_dnf(m: Marts, season: int = SEASON) -> DataFrame:
    s = _season_races(m, season).select("session_key", "meeting_name", "session_start_at")
    r = m.fct_session_results.where(F.col("is_dnf") == F.lit(True))
    return r.join(s, ["session_key"], "inner").orderBy("session_start_at", "driver_name").select("meeting_name", "driver_name", "team_name",
                                                      "classified_position")


def v_fastest_lap_each_race(m: Marts, season: int = SEASON, as_of: dt.datetime = AS_OF) -> DataFrame:
    """Aggregate first, then keep the best per meeting (ties → driver name)."""
    s = _season_races(m, season).where(F.col("session_start_at") < _lit_ts(as_of)).select(
        "session_key", "meeting_name", "country_name", "session_start_at")
    agg = m.fct_laps.join(s, ["session_key"], "inner").groupBy(
        "meeting_name", "country_name", "driver_name", "team_name").agg(
        F.min("lap_duration_s").alias("fastest_lap_s"), F.min("session_start_at").alias("session_start_at"))
    return keep_first(agg, ["meeting_name"], [F.col("fastest_lap_s").asc_nulls_last(),
                                              F.col("driver_name").asc_nulls_last(),
                                              F.col("team_name").asc_nulls_last()]) \
        .orderBy("session_start_at", "meeting_name")


def v_points_last_race(m: Marts) -> DataFrame:
    r = m.fct_session_results.join(_latest_race_with_winner(m), ["session_key"], "left_semi")
    return r.select("driver_name", "driver_acronym", "team_name", "finish_position", "points") \
        .orderBy(F.col("finish_position").asc_nulls_last(), "driver_name")


def v_sprint_results(m: Marts, season: int = SEASON, as_of: dt.datetime = AS_OF, name: str = "Sprint",
                     stype: str | None = None) -> DataFrame:
    """The source filters session_type = 'Sprint' while sprints carry type
    'Race'; name and type are parameters (type None = not filtered)."""
    s = _races(m, name, stype).where((F.col("year") == season) & (F.col("session_start_at") < _lit_ts(as_of)))
    s = s.select("session_key", "meeting_name", "country_name", "session_start_at")
    return m.fct_session_results.join(s, ["session_key"], "inner").orderBy(
        "session_start_at", F.col("finish_position").asc_nulls_last(), "driver_name").select(
        "meeting_name", "country_name", "driver_name", "team_name", "finish_position", "points")


def season_lap_pace_labelled(m: Marts) -> DataFrame:
    """Q25 with display labels."""
    return S.relabel(season_lap_pace(m), {"avg_lap_s": "Avg Lap (s)", "best_lap_s": "Best Lap (s)"})


# ------------------------------------------------------------------ SQL surface
def register_views(spark: SparkSession, m: Marts, sql: str | None = None) -> list[str]:
    """Expose staging models and marts as temporary views.

    With ``sql`` only the models that the statement mentions are built and exposed.
    """
    words = None if sql is None else set(re.findall(r"\w+", sql))
    names = [n for n in (*m.stg, *Marts.NAMES) if words is None or n in words]
    for n in names:
        (m.stg[n] if n.startswith("stg_") else m.get(n)).createOrReplaceTempView(n)
    return names


def run_sql(spark: SparkSession, sql: str, **params) -> DataFrame:
    """Parameterised Spark SQL (named markers, no string interpolation)."""
    return spark.sql(sql, args=params)


LAPS_PER_DRIVER_SQL = """
SELECT l.driver_name, count(*) AS laps, min(l.lap_duration_s) AS best_lap_s
FROM fct_laps l JOIN dim_sessions s ON l.session_key = s.session_key
WHERE s.year = :season AND l.lap_duration_s < :max_s
GROUP BY l.driver_name"""


def sql_laps_per_driver(m: Marts, spark: SparkSession, season: int = SEASON) -> DataFrame:
    register_views(spark, m, LAPS_PER_DRIVER_SQL)
    return run_sql(spark, LAPS_PER_DRIVER_SQL, season=season, max_s=120.0)


# ------------------------------------------------------------------ quality / semantic
def dq_report(m: Marts) -> DataFrame:
    """D1-D3 over the marts and staging models; nulls were counted while they were written."""
    from pitwall.plans.quality import run_checks
    return run_checks(_checked_tables(m), counted=m.counted)


def _checked_tables(m: Marts) -> dict[str, DataFrame]:
    return {**{n: m.get(n) for n in Marts.NAMES}, **{k: v for k, v in m.stg.items()}}


def dq_failing_keys(m: Marts) -> DataFrame:
    """The keys of the rows that fail a check."""
    from pitwall.plans.quality import failing_keys
    return failing_keys(_checked_tables(m), counted=m.counted)


def semantic_lap_metrics(m: Marts) -> DataFrame:
    """Default aggregations by a related dimension and a month grain."""
    from pitwall.plans.semantic import metric
    return metric(m, "fct_laps", ["lap duration", "speed_trap_fl_kmh", "sector_1_s"],
                  by=["year", "session_start_at:month", "tyre_compound"])


def semantic_points_by_team(m: Marts) -> DataFrame:
    from pitwall.plans.semantic import metric
    return metric(m, "fct_session_results", ["points", "finish_position", "positions_gained"],
                  by=["team_name", "year", "session_type"])


def semantic_cross_fact(m: Marts) -> DataFrame:
    """L2/L3: measures of five tables by season and team; championship points as they stood at the last session."""
    from pitwall.plans.semantic import AT_LAST, cross_fact
    return cross_fact(m, {"fct_session_results": ["points"], "fct_laps": ["lap time"], "fct_pit_stops": ["pit time"],
                          "fct_stints": ["stint_length"], "dim_championship_teams": ["points_current"]},
                      ["year", "team_name"], aggregations={"points_current": AT_LAST})


def semantic_weather(m: Marts) -> DataFrame:
    from pitwall.plans.semantic import metric
    return metric(m, "fct_weather", ["air_temp_c", "humidity_pct"], by=["country_name", "is_raining", "recorded_at:day"])


# ------------------------------------------------------------------ registry
QUERIES: dict[str, Callable[[Marts], DataFrame]] = {
    "q01_seasons": seasons,
    "q02_season_calendar": season_calendar,
    "q03_meeting_sessions": meeting_sessions,
    "q04_winner_hero": winner_hero,
    "q05_fastest_lap": fastest_lap,
    "q06_pole_sitter": pole_sitter,
    "q07_session_results": session_results,
    "q08_lap_intervals": lap_intervals,
    "q09_positions_per_lap": positions_per_lap,
    "q10_grid_summary": grid_summary,
    "q11_race_control_timeline": lambda m: race_control_timeline(m, None, ("Flag", "SafetyCar"), ("YELLOW", "RED")),
    "q11_race_control_counts": race_control_counts,
    "q12_race_key": race_key_for,
    "q13_stint_strategy": stint_strategy,
    "q13_driver_order": driver_order,
    "q15_stint_detail": stint_detail,
    "q16_lap_times": lap_times,
    "q16_clean_lap_times": lambda m: lap_times(m, clean_only=True),
    "q17_clean_laps_end": clean_laps_with_end,
    "q18_lap_telemetry": lap_telemetry,
    "q19_track_dominance": track_dominance,
    "q19_track_map": track_map,
    "q20_session_meta": session_meta,
    "fct_race_positions_strict": race_positions_strict,
    "q21_recent_results": recent_results,
    "q22_standings_top10": lambda m: driver_standings(m, top=10),
    "q23_next_race": next_race,
    "q24_season_results": lambda m: recent_results(m, k=5, season=SEASON, with_grid=True),
    "q25_season_lap_pace": season_lap_pace,
    "q25_season_lap_pace_labelled": season_lap_pace_labelled,
    "q26_season_pit_performance": season_pit_performance,
    "q27_season_compounds": season_compounds,
    "q27_remaining_races": remaining_races,
    "v01_races_happened_this_year": v_races_happened,
    "v02_race_count_this_year": v_race_count,
    "v03_race_winners_this_year": v_race_winners,
    "v04_driver_championship_standings": driver_standings,
    "v05_fastest_laps_last_race": v_fastest_laps_last_race,
    "v06_pit_stop_performance": v_pit_stop_performance,
    "v07_cancelled_races_this_year": v_cancelled_races,
    "v08_upcoming_races_this_year": v_upcoming_races,
    "v09_constructor_championship_standings": v_constructor_standings,
    "v10_driver_wins_this_season": v_driver_wins,
    "v11_tyre_strategy_last_race": v_tyre_strategy_last_race,
    "v12_pole_positions_this_season": v_pole_positions,
    "v13_dnf_this_season": v_dnf,
    "v14_fastest_lap_each_race_this_season": v_fastest_lap_each_race,
    "v15_points_scored_per_driver_last_race": v_points_last_race,
    "v16_sprint_results_this_season": v_sprint_results,
    "dq_report": dq_report,
    "dq_failing_keys": dq_failing_keys,
    "semantic_lap_metrics": semantic_lap_metrics,
    "semantic_points_by_team": semantic_points_by_team,
    "semantic_weather": semantic_weather,
    "semantic_cross_fact": semantic_cross_fact,
}


NAMED: dict[str, Callable[..., DataFrame]] = {
    "seasons": seasons, "season_calendar": season_calendar, "meeting_sessions": meeting_sessions,
    "winner_hero": winner_hero, "fastest_lap": fastest_lap, "pole_sitter": pole_sitter,
    "session_results": session_results, "lap_intervals": lap_intervals, "positions_per_lap": positions_per_lap,
    "grid_summary": grid_summary, "race_control_timeline": race_control_timeline, "race_key": race_key_for,
    "stint_strategy": stint_strategy, "driver_order": driver_order, "stint_detail": stint_detail,
    "lap_times": lap_times, "clean_laps_with_end": clean_laps_with_end, "lap_telemetry": lap_telemetry,
    "track_dominance": track_dominance, "track_map": track_map, "session_meta": session_meta,
    "recent_results": recent_results, "driver_standings": driver_standings, "next_race": next_race,
    "season_lap_pace": season_lap_pace, "season_pit_performance": season_pit_performance,
    "season_compounds": season_compounds, "remaining_races": remaining_races,
}


def query(m: Marts, name: str, **params) -> DataFrame:
    """A catalogue query by name with its parameters, e.g. ``query(m, "lap_times", session_key=7)``."""
    return NAMED[name](m, **params)


def positions_without_laps(m: Marts) -> DataFrame:
    """Q9 / W7 where odd sessions have no laps: their samples are numbered per driver instead."""
    tables = {n: m.stg[n] for n in ("stg_position", "stg_drivers", "stg_sessions", "stg_starting_grid",
                                    "stg_session_result", "stg_stints")}
    some = Marts({**tables, "stg_laps": m.stg["stg_laps"].where("session_key % 2 = 0")}, m.strict_grid)
    return positions_per_lap(some)


# what incremental_marts reports per session and driver of each refreshed mart
REFRESH_MEASURES = {
    "fct_laps": "lap_number + coalesce(tyre_age_on_lap, 0)", "fct_stints": "clean_laps * 100 + stint_length",
    "fct_pit_stops": "lap_number * 100 + coalesce(stint_number, 0)",
    "fct_session_results": "coalesce(finish_position, 0) * 1000 + coalesce(grid_position, 0)"}


def refreshed_store(c: RaceContext):
    """Marts built from the first loads, then refreshed by a batch of corrections and late grids.

    Returns the store and the reached sessions per mart.
    """
    from pitwall.functions.variant import extract
    from pitwall.plans.refresh import MartStore, sources_of
    from pitwall.plans.staging import MODELS
    late, session = F.col("loaded_at") > F.lit("2024-01-01").cast("timestamp_ntz"), extract("session_key", "int")
    store = MartStore(c.spark, f"{c.run_dir}/refresh-{uuid.uuid4().hex}", tuple(REFRESH_MEASURES))
    first, batch = {}, {}
    for name in sources_of(store.names):
        endpoint = MODELS[name].endpoint
        sent = F.coalesce(late & (session % 3 == 1), F.lit(False)) if endpoint != "starting_grid" else session % 4 == 2
        raw = c.raw_table(endpoint)
        first[endpoint] = raw if endpoint == "meetings" else raw.where(~sent)
        if endpoint != "meetings":
            batch[endpoint] = raw.where(sent)
    store.build(first)
    return store, store.refresh(batch)


def incremental_marts(c: RaceContext) -> DataFrame:
    """Rows and a measure per (mart, session, driver) of the refreshed marts; equal to a full build's."""
    store, _ = refreshed_store(c)
    parts = [store.mart(m).groupBy("session_key", "driver_number").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.expr(x)).cast("long").alias("total")).select(F.lit(m).alias("mart"), "*")
        for m, x in REFRESH_MEASURES.items()]
    return reduce(DataFrame.unionByName, parts)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from pitwall.catalog import ctx

    def bind(fn):
        return lambda spark, sf_dir: fn(ctx(spark, sf_dir).marts)
    out = {name: bind(fn) for name, fn in QUERIES.items()}
    out["q09_sessions_without_laps"] = lambda spark, sf_dir: positions_without_laps(ctx(spark, sf_dir).marts)
    out["incremental_marts"] = lambda spark, sf_dir: incremental_marts(ctx(spark, sf_dir))
    out["s14_sql_laps_per_driver"] = lambda spark, sf_dir: sql_laps_per_driver(ctx(spark, sf_dir).marts, spark)
    return out
