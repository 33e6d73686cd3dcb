"""Semantic layer (L1-L6): logical tables with dimensions, time dimensions
and measures carrying a default aggregation, many-to-one relationships to
the session dimension, synonyms, and a ``metric()`` compiler to DataFrame
operations (group-by + default aggregates, auto-joining related tables and
truncating time dimensions to a grain); ``cross_fact()`` puts measures of
several tables side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwall.functions import scalars as S

def _avg(c: Column) -> Column:
    from pitwall.plans.marts import exact_avg
    return exact_avg(c)


# Of a standing: its sum at the group's last session, not over sessions (semi-additive).
AT_LAST, LAST_OF = "at_last", "session_key"
AGGS = {"min": F.min, "max": F.max, "sum": F.sum, "avg": _avg, "count": F.count}


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class LogicalTable:
    name: str
    dimensions: tuple[str, ...]
    time_dimensions: tuple[str, ...] = ()
    measures: tuple[Measure, ...] = ()
    primary_key: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relationship:
    left: str
    right: str
    on: tuple[str, ...]
    how: str = "left"          # left outer, many-to-one


@dataclass
class SemanticModel:
    tables: dict[str, LogicalTable]
    relationships: list[Relationship] = field(default_factory=list)

    def measure(self, table: str, name: str) -> Measure:
        for m in self.tables[table].measures:
            if name == m.name or name in m.synonyms:
                return m
        raise KeyError(f"{table} has no measure {name!r}")

    def related(self, table: str) -> list[Relationship]:
        return [r for r in self.relationships if r.left == table]


def _m(name, agg, *syn):
    return Measure(name, agg, tuple(syn))


_DRV = ("session_key", "driver_number", "driver_name", "driver_acronym", "team_name")

MODEL = SemanticModel(
    tables={t.name: t for t in [
        LogicalTable("dim_sessions", ("session_key", "meeting_key", "session_name", "session_type",
                                      "circuit_short_name", "country_name", "location", "year", "meeting_name",
                                      "meeting_official_name"), ("session_start_at", "session_end_at"),
                     primary_key=("session_key",)),
        LogicalTable("dim_drivers", ("session_key", "driver_number", "full_name", "acronym", "team_name",
                                     "team_colour", "country_code"), primary_key=("session_key", "driver_number")),
        LogicalTable("fct_session_results", (*_DRV, "session_type", "classified_position", "is_dnf", "is_dns",
                                             "is_dsq"), (),
                     (_m("finish_position", "min"), _m("grid_position", "min"),
                      _m("positions_gained", "sum"), _m("points", "sum"),
                      _m("laps_completed", "sum"), _m("race_duration_s", "min")),
                     ("session_key", "driver_number")),
        LogicalTable("fct_laps", (*_DRV, "lap_number", "tyre_compound", "is_pit_out_lap", "tyre_age_on_lap"),
                     ("lap_start_at",),
                     (_m("lap_duration_s", "min", "lap time", "lap duration"), _m("sector_1_s", "min"),
                      _m("sector_2_s", "min"), _m("sector_3_s", "min"), _m("speed_trap_fl_kmh", "max"))),
        LogicalTable("fct_stints", (*_DRV, "stint_number", "tyre_compound", "lap_start", "lap_end"), (),
                     (_m("stint_length", "sum"), _m("fastest_lap_s", "min"), _m("avg_lap_time_s", "avg"),
                      _m("deg_per_lap_s", "avg"), _m("tyre_age_at_start", "min"))),
        LogicalTable("fct_pit_stops", (*_DRV, "lap_number", "tyre_compound_out", "tyre_compound_in", "stint_number"),
                     ("pit_at",), (_m("pit_duration_s", "min", "pit time", "pit stop time", "pit stop duration"),)),
        LogicalTable("dim_championship_drivers", ("session_key", "meeting_key", "driver_number",
                                                  "championship_position", "championship_position_start", "year"),
                     (), (_m("points_current", "max"), _m("points_start", "max"))),
        LogicalTable("dim_championship_teams", ("session_key", "meeting_key", "team_name", "championship_position",
                                                "year"), (), (_m("points_current", "max"),)),
        LogicalTable("fct_weather", ("session_key", "session_name", "circuit_short_name", "country_name",
                                     "is_raining"), ("recorded_at",),
                     (_m("air_temp_c", "avg"), _m("track_temp_c", "avg"), _m("humidity_pct", "avg"),
                      _m("wind_speed_ms", "avg")), ("session_key", "recorded_at")),
        LogicalTable("fct_race_control", ("session_key", "category", "flag", "lap_number", "message", "scope",
                                          "driver_name", "circuit_short_name", "country_name"), ("recorded_at",)),
        LogicalTable("fct_intervals", _DRV, ("recorded_at",),
                     (_m("gap_to_leader_s", "min"), _m("interval_to_ahead_s", "min"))),
        LogicalTable("fct_overtakes", ("session_key", "driver_overtaking", "driver_overtaken", "lap_number",
                                       "driver_overtaking_name", "driver_overtaken_name", "team_overtaking",
                                       "team_overtaken"), ("recorded_at",)),
        LogicalTable("fct_starting_grid", (*_DRV, "meeting_name", "session_name", "year"), (),
                     (_m("grid_position", "min"),), ("session_key", "driver_number")),
        LogicalTable("dim_meetings", ("meeting_key", "meeting_name", "meeting_official_name", "circuit_short_name",
                                      "country_name", "location", "year"), ("meeting_start_at",),
                     primary_key=("meeting_key",)),
    ]},
    relationships=[Relationship(f, "dim_sessions", ("session_key",)) for f in (
        "fct_session_results", "fct_laps", "fct_stints", "fct_pit_stops", "dim_championship_drivers",
        "dim_championship_teams", "fct_weather", "fct_race_control", "fct_intervals", "fct_overtakes",
        "fct_starting_grid")],
)


# fixed values: sample values of dimensions
SAMPLE_VALUES: dict[tuple[str, str], tuple] = {
    ("dim_sessions", "session_name"): ("Race", "Qualifying", "Sprint", "Sprint Qualifying", "Practice 1", "Practice 2",
                                       "Practice 3"),
    ("dim_sessions", "session_type"): ("Race", "Qualifying", "Practice", "Sprint"),
    ("dim_sessions", "circuit_short_name"): ("Monza", "Silverstone", "Spa", "Monaco", "Suzuka"),
    ("dim_sessions", "year"): (2023, 2024, 2025, 2026),
    ("dim_drivers", "acronym"): ("VER", "HAM", "LEC", "NOR", "PIA", "SAI", "RUS", "ALO", "STR", "PER"),
    ("dim_drivers", "team_name"): ("Red Bull Racing", "Mercedes", "Ferrari", "McLaren", "Aston Martin", "Alpine",
                                   "Williams", "AlphaTauri", "Alfa Romeo", "Haas F1 Team"),
    ("fct_session_results", "classified_position"): ("Classified", "DNF", "DNS", "DSQ"),
    ("fct_laps", "tyre_compound"): ("SOFT", "MEDIUM", "HARD", "INTERMEDIATE", "WET"),
    ("fct_stints", "tyre_compound"): ("SOFT", "MEDIUM", "HARD", "INTERMEDIATE", "WET"),
    ("fct_race_control", "category"): ("Flag", "SafetyCar", "Drs", "ChequeredFlag"),
    ("fct_race_control", "flag"): ("GREEN", "YELLOW", "RED", "SAFETY CAR", "VIRTUAL SAFETY CAR", "CHEQUERED"),
}

# What the tables and their less obvious columns hold.
DESCRIPTIONS: dict[tuple[str, str | None], str] = {
    ("dim_sessions", None): "Sessions of race weekends, with meeting and circuit.",
    ("dim_drivers", None): "Drivers, a row per driver and session, with team and country.",
    ("dim_meetings", None): "Race weekends with circuit, country and place.",
    ("dim_championship_drivers", None): "Drivers' championship after each session.",
    ("dim_championship_teams", None): "Constructors' championship after each session.",
    ("fct_session_results", None): "Results per driver and session: finish, grid, points, classification.",
    ("fct_session_results", "positions_gained"): "Finish less grid position; below zero, places were gained.",
    ("fct_laps", None): "Lap and sector times per driver and session, with the tyre of the lap.",
    ("fct_laps", "lap_duration_s"): "Lap time in seconds.",
    ("fct_laps", "is_pit_out_lap"): "The lap began in the pit lane.",
    ("fct_stints", None): "Tyre stints: length, pace and degradation.",
    ("fct_stints", "deg_per_lap_s"): "Seconds lost per lap over the stint; above zero, it got slower.",
    ("fct_pit_stops", None): "Pit stops: duration, tyre taken off and put on.",
    ("fct_pit_stops", "pit_duration_s"): "Duration of the stop in seconds.",
    ("fct_weather", None): "Weather samples of sessions.",
    ("fct_race_control", None): "Messages of race control: flags, safety cars, penalties.",
    ("fct_intervals", None): "Gaps to the leader and to the car ahead during sessions.",
    ("fct_overtakes", None): "Overtakes: who passed whom, on which lap.",
    ("fct_starting_grid", None): "Grid positions per driver and qualifying session.",
}


def describe(table: str, column: str | None = None) -> dict:
    """L4: description, synonyms and sample values of a logical table or one of its columns."""
    measures = {m.name: m.synonyms for m in MODEL.tables[table].measures}
    return {"description": DESCRIPTIONS.get((table, column)), "synonyms": measures.get(column, ()),
            "sample_values": SAMPLE_VALUES.get((table, column), ())}


def is_completed(winner: Column, start_at: Column, as_of) -> Column:
    """The model's completed / cancelled rule (see F16)."""
    return S.race_status(winner, start_at, as_of)


def metric(marts, table: str, measures: Sequence[str], by: Sequence[str] = (), where: Column | None = None,
           model: SemanticModel = MODEL, aggregations: Mapping[str, str] | None = None) -> DataFrame:
    """Aggregate measures of a logical table by dimensions.

    ``by`` items are dimension names of the table or of a related table
    (joined automatically along the declared relationship), or
    ``time_dimension:grain`` (date_trunc). Measures use their default
    aggregation unless overridden in ``aggregations``; output columns are
    named like the measures.
    """
    lt = model.tables[table]
    df = marts.get(table)
    own = set(lt.dimensions) | set(lt.time_dimensions)
    groups: list[Column] = []
    needed_related: dict[str, set[str]] = {}
    for item in by:
        name, _, grain = item.partition(":")
        if name not in own:
            rel = next((r for r in model.related(table)
                        if name in model.tables[r.right].dimensions + model.tables[r.right].time_dimensions), None)
            if rel is None:
                raise KeyError(f"{name!r} is not a dimension of {table} or its related tables")
            needed_related.setdefault(rel.right, set()).add(name)
        col = F.col(name)
        # date_trunc answers in the session time zone; cast back so a wall-clock
        # (TIMESTAMP_NTZ) dimension stays wall-clock whatever the session zone
        groups.append(F.date_trunc(grain, col).cast("timestamp_ntz").alias(f"{name}_{grain}") if grain
                      else col.alias(name))
    for right, cols in needed_related.items():
        rel = next(r for r in model.related(table) if r.right == right)
        key = model.tables[right].primary_key
        if not key or not set(key) <= set(rel.on):
            raise ValueError(f"joining {right} on {rel.on} could multiply rows of {table}")
        df = df.join(marts.get(right).select(*rel.on, *sorted(cols)), list(rel.on), rel.how)
    if where is not None:
        df = df.where(where)
    aggs, at_last = [], []
    for mname in measures:
        m = model.measure(table, mname)
        agg = (aggregations or {}).get(m.name, m.agg)
        if agg == AT_LAST:
            at_last.append(m.name)
        else:
            aggs.append(AGGS[agg](F.col(m.name)).alias(m.name))
    if not at_last:
        return df.groupBy(*groups).agg(*aggs)
    if LAST_OF not in own:
        raise ValueError(f"{table} has no {LAST_OF} to take the last one of")
    grouped = df.select(*groups, F.col(LAST_OF).alias("_last"), *[F.col(m) for m in at_last])
    keys = [c for c in grouped.columns if c not in ("_last", *at_last)]
    per_session = grouped.groupBy(*keys, "_last").agg(*[F.sum(m).alias(m) for m in at_last])
    last = per_session.groupBy(*keys).agg(*[F.max_by(m, "_last").alias(m) for m in at_last])
    return beside([df.groupBy(*groups).agg(*aggs), last], keys) if aggs else last


def beside(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Frames with one row per key side by side (a full join in which null keys meet): one union, one shuffle."""
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    values = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])


def cross_fact(marts, measures: Mapping[str, Sequence[str]], by: Sequence[str],
               where: Mapping[str, Column] | None = None, model: SemanticModel = MODEL,
               aggregations: Mapping[str, str] | None = None) -> DataFrame:
    """Measures of several logical tables by dimensions that all of them have or reach.

    Each table is aggregated on the shared dimensions by itself and only the
    results meet, so no fact's rows are multiplied by another's. A key that
    some tables lack has nulls there. A measure name that two tables share is
    prefixed with its table's name.
    """
    named = [model.measure(t, m).name for t, ms in measures.items() for m in ms]
    frames, keys = [], None
    for t, ms in measures.items():
        f = metric(marts, t, ms, by, (where or {}).get(t), model, aggregations)
        own = [model.measure(t, m).name for m in ms]
        keys = [c for c in f.columns if c not in own]
        frames.append(f.select(*keys, *[F.col(c).alias(f"{t}_{c}" if named.count(c) > 1 else c) for c in own]))
    return beside(frames, keys)
