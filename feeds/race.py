"""Race-shaped RAW endpoint tables derived from the driver tables.

Every function returns ``(raw_data VARIANT, loaded_at TIMESTAMP)`` rows, the
landing shape, so staging, marts and queries run on data whose volume grows
with the driver tables. Derivations use integer arithmetic, ``row_number``
over a total order and timestamp addition only, so an independent SQL engine
can rebuild the same rows. Re-emitted versions exercise latest-per-key:
corrections (newer, changed value), JSON-null values and missing paths.
Dates are ISO-8601 text with an offset, as the source API sends them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.operators.timeseries import seq_index
from pitwall.sources.tables import Tables

# Fixed load times of the original load (L0), a correction (L1) and a later
# re-send (L2); wall-clock values, so results do not depend on a time zone.
L0, L1, L2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00"

SESSION_NAMES = "array('Practice 1', 'Qualifying', 'Sprint Qualifying', 'Sprint', 'Race')"
SESSION_TYPES = "array('Practice', 'Qualifying', 'Qualifying', 'Race', 'Race')"
COMPOUNDS = "array('HARD', 'SOFT', 'MEDIUM')"          # indexed by stint_number % 3 + 1
POINTS = "array(25.0, 18.0, 15.0, 12.0, 10.0, 8.0, 6.0, 4.0, 2.0, 1.0)"
CATEGORIES = "array('Flag', 'SafetyCar', 'Other')"
SCOPES = "array('Track', 'Driver', 'Sector')"

# events → session of type Race / driver / instant
EV_SESSION = "(user_id % 25 + 1) * 10 + 5"
EV_DRIVER = "event_id % 10 + 1"


def start_of(session_key: str) -> str:
    """Start of a session from its key (meeting = key div 10, slot = key % 10)."""
    n = f"(({session_key}) div 10 - 1)"
    return (f"timestampadd(DAY, 7 * {n} + ({session_key}) % 10, "
            f"make_timestamp_ntz(2023 + {n} % 3, 3, 1, 12, 0, 0))")


def ev_time(session_key: str) -> str:
    return (f"timestampadd(MICROSECOND, (event_id div 25) * 2600000 + (event_id % 25) * 100000, "
            f"{start_of(session_key)})")


def iso(ts_col: str) -> str:
    return f"concat(date_format({ts_col}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '+00:00')"


def _raw(df: DataFrame, fields: list[str], loaded_at: str) -> DataFrame:
    """Pack the named columns of ``df`` into one VARIANT object per row."""
    return df.select(F.to_variant_object(F.struct(*fields)).alias("raw_data"),
                     F.lit(loaded_at).cast("timestamp_ntz").alias("loaded_at"))


# --------------------------------------------------------------------------- bulk endpoints
def meetings_typed(t: Tables) -> DataFrame:
    return t.nation.selectExpr(
        "n_nationkey + 1 AS meeting_key",
        "concat(n_name, ' Grand Prix') AS meeting_name",
        "concat('FORMULA 1 ', upper(n_name), ' GRAND PRIX') AS meeting_official_name",
        "n_nationkey + 100 AS circuit_key",
        "lower(n_name) AS circuit_short_name",
        "n_name AS country_name",
        "concat(n_name, ' City') AS location",
        "2023 + n_nationkey % 3 AS year",
        f"{start_of('(n_nationkey + 1) * 10')} AS date_start")


MEETING_FIELDS = ["meeting_key", "meeting_name", "meeting_official_name", "circuit_key",
                  "circuit_short_name", "country_name", "location", "year", "date_start"]


def meetings(t: Tables) -> DataFrame:
    m = meetings_typed(t).withColumn("date_start", F.expr(iso("date_start")))
    rev = m.where("meeting_key % 5 = 1").withColumn("meeting_name", F.concat("meeting_name", F.lit(" (rev)")))
    return _raw(m, MEETING_FIELDS, L0).unionByName(_raw(rev, MEETING_FIELDS, L1))


def sessions_typed(t: Tables) -> DataFrame:
    return (meetings_typed(t).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5))))
            .selectExpr("meeting_key * 10 + i AS session_key",
                        f"element_at({SESSION_NAMES}, cast(i AS int)) AS session_name",
                        f"element_at({SESSION_TYPES}, cast(i AS int)) AS session_type",
                        "meeting_key", "circuit_key", "circuit_short_name", "country_name",
                        "location", "year",
                        "timestampadd(DAY, i, date_start) AS date_start",
                        "timestampadd(HOUR, 2, timestampadd(DAY, i, date_start)) AS date_end"))


SESSION_FIELDS = ["session_key", "session_name", "session_type", "meeting_key", "circuit_key",
                  "circuit_short_name", "country_name", "location", "year", "date_start", "date_end"]


def sessions(t: Tables) -> DataFrame:
    s = sessions_typed(t).withColumn("date_start", F.expr(iso("date_start"))) \
                         .withColumn("date_end", F.expr(iso("date_end")))
    rev = s.where("session_key % 7 = 0").withColumn("location", F.concat("location", F.lit(" *")))
    return _raw(s, SESSION_FIELDS, L0).unionByName(_raw(rev, SESSION_FIELDS, L1))


def _session_drivers(t: Tables) -> DataFrame:
    return (sessions_typed(t).select("session_key", "session_type", "session_name", "meeting_key")
            .withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(10)))))


DRIVER_FIELDS = ["session_key", "driver_number", "broadcast_name", "full_name", "name_acronym",
                 "team_name", "team_colour", "country_code", "headshot_url"]


def drivers(t: Tables) -> DataFrame:
    d = (_session_drivers(t).where("NOT (d = 10 AND session_key % 3 = 0)")
         .selectExpr("session_key", "d AS driver_number",
                     "concat('DRV ', d) AS broadcast_name",
                     "concat('Driver ', d) AS full_name",
                     "concat('D', lpad(cast(d AS string), 2, '0')) AS name_acronym",
                     "concat('Team ', (d + 1) div 2) AS team_name",
                     "concat('C', d) AS team_colour",
                     "concat('K', d % 3) AS country_code",
                     "concat('img/', d, '.png') AS headshot_url"))
    rev = d.where("(session_key + driver_number) % 7 = 0").withColumn(
        "team_colour", F.concat(F.lit("X"), F.col("driver_number").cast("string")))
    return _raw(d, DRIVER_FIELDS, L0).unionByName(_raw(rev, DRIVER_FIELDS, L1))


# --------------------------------------------------------------------------- laps / stints / pit
def laps_typed(t: Tables) -> DataFrame:
    """One lap per lineitem row; lap_number is the row's rank inside its
    (session, driver) under a total order of all its columns. Used by the
    laps, stints and pit feeds, so it is built once per context."""
    return t.derived("laps_typed", lambda: _laps_typed(t))


def _laps_typed(t: Tables) -> DataFrame:
    li = t.lineitem.selectExpr(
        "*", "(l_orderkey % 25 + 1) * 10 + (l_partkey % 5 + 1) AS session_key",
        "l_suppkey % 10 + 1 AS driver_number")
    # only ~1,250 (session, driver) series exist: number rows per (series, order-key bucket) and
    # shift by earlier buckets so no series is sorted in a single task
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                                "l_shipdate")]
    li = seq_index(li, ["session_key", "driver_number"], order, "lap_number", 1, bucket=("l_orderkey", 65536),
                   rows=t.lineitem.count())
    return li.selectExpr(
        "session_key", "driver_number", "lap_number", "l_orderkey", "l_linenumber", "l_tax",
        "80 + 200 * l_discount + l_quantity / 10 + CASE WHEN l_linenumber = 7 THEN 30 ELSE 0 END AS lap_duration",
        f"{start_of('session_key')} AS session_start",
        "cast(200 + l_partkey % 100 AS double) AS i1_speed",
        "cast(210 + l_suppkey % 50 AS double) AS i2_speed",
        "250 + l_quantity AS st_speed",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE lap_number % 8 = 1 AND lap_number > 1 END AS is_pit_out_lap",
    ).selectExpr("*", "lap_duration * 0.3 AS duration_sector_1", "lap_duration * 0.35 AS duration_sector_2",
                 "lap_duration * 0.35 AS duration_sector_3",
                 "timestampadd(SECOND, 130 * (lap_number - 1), session_start) AS date_start")


LAP_FIELDS = ["session_key", "driver_number", "lap_number", "lap_duration", "duration_sector_1",
              "duration_sector_2", "duration_sector_3", "i1_speed", "i2_speed", "st_speed",
              "is_pit_out_lap", "date_start"]


def laps(t: Tables) -> DataFrame:
    lt = laps_typed(t).withColumn("date_start", F.expr(iso("date_start")))
    corr = lt.where("l_orderkey % 11 = 0").withColumn("lap_duration", F.col("lap_duration") + 0.5)
    nul = lt.where("l_orderkey % 13 = 0").withColumn("lap_duration", F.lit(None).cast("double"))
    missing = [f for f in LAP_FIELDS if f != "lap_duration"]
    return (_raw(lt, LAP_FIELDS, L0).unionByName(_raw(corr, LAP_FIELDS, L1))
            .unionByName(_raw(nul, LAP_FIELDS, L2))
            .unionByName(_raw(lt.where("l_orderkey % 17 = 0"), missing, L2)))


def stints_typed(t: Tables) -> DataFrame:
    """Blocks of 8 laps; some blocks dropped (gaps), some extended by 2 laps (overlaps)."""
    s = (laps_typed(t).withColumn("stint_number", F.expr("(lap_number - 1) div 8 + 1"))
         .groupBy("session_key", "driver_number", "stint_number")
         .agg(F.min("lap_number").alias("lap_start"), F.max("lap_number").alias("lap_end")))
    return s.where("(session_key + driver_number + stint_number) % 9 <> 0").selectExpr(
        "session_key", "driver_number", "stint_number", "lap_start",
        "CASE WHEN (session_key + driver_number + stint_number) % 10 = 0 THEN lap_end + 2 ELSE lap_end END AS lap_end",
        f"element_at({COMPOUNDS}, cast(stint_number % 3 + 1 AS int)) AS compound",
        "(stint_number % 4) * 2 AS tyre_age_at_start")


STINT_FIELDS = ["session_key", "driver_number", "stint_number", "lap_start", "lap_end", "compound",
                "tyre_age_at_start"]


def stints(t: Tables) -> DataFrame:
    s = stints_typed(t)
    corr = s.where("stint_number = 2 AND (session_key + driver_number) % 3 = 0").withColumn(
        "compound", F.lit("INTERMEDIATE"))
    nul = s.where("stint_number = 1 AND (session_key + driver_number) % 4 = 0").withColumn(
        "compound", F.lit(None).cast("string"))
    return (_raw(s, STINT_FIELDS, L0).unionByName(_raw(corr, STINT_FIELDS, L1))
            .unionByName(_raw(nul, STINT_FIELDS, L2)))


PIT_FIELDS = ["session_key", "driver_number", "lap_number", "pit_duration", "date"]


def pit(t: Tables) -> DataFrame:
    lt = laps_typed(t)
    lt = lt.join(lt.groupBy("session_key", "driver_number").agg(F.max("lap_number").alias("max_lap")),
                 ["session_key", "driver_number"])
    p = lt.where("lap_number % 8 = 0 AND lap_number < max_lap").selectExpr(
        "session_key", "driver_number", "lap_number",
        "CASE WHEN l_linenumber = 3 THEN NULL ELSE 20 + l_tax * 100 END AS pit_duration",
        iso("timestampadd(SECOND, 95, date_start)") + " AS date")
    corr = p.where("lap_number = 16").withColumn("pit_duration", F.col("pit_duration") + 1)
    return _raw(p, PIT_FIELDS, L0).unionByName(_raw(corr, PIT_FIELDS, L1))


# --------------------------------------------------------------------------- event streams
def _events(t: Tables, where: str | None = None) -> DataFrame:
    e = t.events
    if where:
        e = e.where(where)
    return e.selectExpr("*", f"{EV_SESSION} AS session_key", f"{EV_DRIVER} AS driver_number",
                        iso(ev_time(EV_SESSION)) + " AS date")


def position(t: Tables) -> DataFrame:
    f = ["session_key", "driver_number", "position", "date"]
    p = _events(t).selectExpr("*", "(event_id div 10) % 20 + 1 AS position")
    corr = p.where("event_id % 19 = 0").withColumn("position", F.expr("position % 20 + 1"))
    return _raw(p, f, L0).unionByName(_raw(corr, f, L1))


def intervals(t: Tables) -> DataFrame:
    f = ["session_key", "driver_number", "gap_to_leader", "interval", "date"]
    e = _events(t, "event_type IN ('view', 'click')").selectExpr(
        "*",
        "CASE WHEN event_id % 13 = 0 THEN cast('+1 LAP' AS variant) "
        "WHEN event_id % 23 = 0 THEN cast(cast(value AS string) AS variant) "
        "ELSE cast(value AS variant) END AS gap_to_leader",
        "CASE WHEN event_id % 17 = 0 THEN cast('+1 LAP' AS variant) ELSE cast(value / 2 AS variant) END AS interval")
    return _raw(e, f, L0)


def car_data(t: Tables) -> DataFrame:
    f = ["session_key", "driver_number", "speed", "throttle", "brake", "drs", "n_gear", "rpm", "date"]
    e = _events(t).selectExpr(
        "*", "cast(floor(value) AS int) + 100 AS speed", "cast(event_id % 101 AS int) AS throttle",
        "CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS brake", "cast((event_id % 4) * 4 AS int) AS drs",
        "cast(event_id % 8 + 1 AS int) AS n_gear", "cast(9000 + event_id % 3000 AS int) AS rpm")
    return _raw(e, f, L0)


def location(t: Tables) -> DataFrame:
    f = ["session_key", "driver_number", "x", "y", "z", "date"]
    e = t.events.selectExpr(
        "*", f"{EV_SESSION} AS session_key", f"{EV_DRIVER} AS driver_number",
        iso(f"timestampadd(SECOND, 2, {ev_time(EV_SESSION)})") + " AS date",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * 10 END AS x",
        "(event_id % 100) * 1.5 AS y", "(event_id % 7) * 0.5 AS z")
    return _raw(e, f, L0)


def weather(t: Tables) -> DataFrame:
    f = ["session_key", "air_temperature", "track_temperature", "humidity", "pressure", "wind_speed",
         "wind_direction", "rainfall", "date"]
    e = _events(t, "event_type = 'view'").selectExpr(
        "*", "20 + value / 10 AS air_temperature", "30 + value / 5 AS track_temperature",
        "cast(40 + event_id % 30 AS double) AS humidity", "cast(1000 + event_id % 20 AS double) AS pressure",
        "value / 20 AS wind_speed", "cast(event_id % 360 AS int) AS wind_direction",
        "cast(event_id % 2 AS int) AS rainfall")
    return _raw(e, f, L0)


def race_control(t: Tables) -> DataFrame:
    f = ["session_key", "driver_number", "category", "flag", "lap_number", "message", "scope", "sector", "date"]
    e = _events(t, "event_type = 'error'").selectExpr(
        "session_key", "date",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE driver_number END AS driver_number",
        f"element_at({CATEGORIES}, cast(event_id % 3 AS int) + 1) AS category",
        "CASE event_id % 5 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'YELLOW' WHEN 2 THEN ' yellow ' WHEN 3 THEN 'RED' END AS flag",
        "cast(event_id % 50 + 1 AS int) AS lap_number", "concat('MSG ', event_id) AS message",
        f"element_at({SCOPES}, cast(event_id % 3 AS int) + 1) AS scope",
        "CASE WHEN event_id % 3 = 2 THEN cast((event_id div 3) % 3 + 1 AS int) END AS sector")
    return _raw(e, f, L0)


def team_radio(t: Tables) -> DataFrame:
    f = ["session_key", "driver_number", "recording_url", "date"]
    e = _events(t, "event_type = 'click'").selectExpr("*", "concat('radio/', event_id, '.mp3') AS recording_url")
    return _raw(e, f, L0)


def overtakes(t: Tables) -> DataFrame:
    f = ["session_key", "overtaking_driver_number", "overtaken_driver_number", "lap_number", "date"]
    e = _events(t, "event_type = 'purchase'").selectExpr(
        "*", "driver_number AS overtaking_driver_number", "driver_number % 10 + 1 AS overtaken_driver_number",
        "cast(event_id % 50 + 1 AS int) AS lap_number")
    return _raw(e, f, L0)


# --------------------------------------------------------------------------- results / grid / standings
RESULT_FIELDS = ["session_key", "driver_number", "position", "points", "classified_position", "dnf", "dns",
                 "dsq", "number_of_laps", "duration", "gap_to_leader"]


def session_result(t: Tables) -> DataFrame:
    r = (_session_drivers(t).where("meeting_key % 4 <> 0")
         .selectExpr("*", "CASE WHEN (d + session_key) % 11 = 0 THEN NULL ELSE (d * 7 + session_key) % 10 + 1 END AS pos")
         .selectExpr(
             "session_key", "d AS driver_number", "pos AS position",
             f"CASE WHEN pos IS NULL THEN cast(NULL AS variant) "
             f"WHEN (d + session_key) % 6 = 0 THEN cast(cast(try_element_at({POINTS}, cast(pos AS int)) AS string) AS variant) "
             f"ELSE cast(try_element_at({POINTS}, cast(pos AS int)) AS variant) END AS points",
             "coalesce(cast(pos AS string), 'NC') AS classified_position",
             "(d + session_key) % 11 = 0 OR (d * 2 + session_key) % 13 = 0 AS dnf",
             "(d * 3 + session_key) % 17 = 0 AS dns",
             "(d + 2 * session_key) % 19 = 0 AS dsq",
             "CASE WHEN (d * 3 + session_key) % 17 = 0 THEN 0 ELSE 50 - d % 3 END AS number_of_laps",
             "CASE WHEN session_type = 'Race' THEN cast(5400.5 + d * 3.25 AS variant) "
             "WHEN session_type = 'Qualifying' THEN parse_json('[90.1, 89.5, 88.9]') "
             "ELSE cast('1:30.5' AS variant) END AS duration",
             "CASE WHEN pos = 1 THEN NULL ELSE concat('+', d, '.5s') END AS gap_to_leader"))
    corr = r.where("driver_number = 2 AND session_key % 4 = 0").withColumn(
        "number_of_laps", F.col("number_of_laps") - 1)
    return _raw(r, RESULT_FIELDS, L0).unionByName(_raw(corr, RESULT_FIELDS, L1))


def starting_grid(t: Tables) -> DataFrame:
    f = ["session_key", "meeting_key", "driver_number", "position"]
    g = (_session_drivers(t).where("session_type = 'Qualifying' AND meeting_key % 4 <> 0")
         .selectExpr("session_key", "meeting_key", "d AS driver_number", "(d * 3 + session_key) % 10 + 1 AS position"))
    return _raw(g, f, L0)


def championship_drivers(t: Tables) -> DataFrame:
    f = ["session_key", "meeting_key", "driver_number", "points_current", "points_start",
         "position_current", "position_start"]
    c = (_session_drivers(t).where("session_name = 'Race'").selectExpr(
        "session_key", "meeting_key", "d AS driver_number",
        "cast((11 - d) * 10 + meeting_key AS double) AS points_current",
        "cast((11 - d) * 10 AS double) AS points_start", "d AS position_current", "d AS position_start"))
    json_null = c.where("meeting_key = 3 AND driver_number = 1").withColumn(
        "driver_number", F.lit(None).cast("int")).withColumn("position_current", F.lit(11))
    missing = c.where("meeting_key = 4 AND driver_number = 1")
    return (_raw(c, f, L0).unionByName(_raw(json_null, f, L0))
            .unionByName(_raw(missing, [x for x in f if x != "driver_number"], L0)))


def championship_teams(t: Tables) -> DataFrame:
    f = ["session_key", "meeting_key", "team_name", "points_current", "points_start",
         "position_current", "position_start"]
    c = (_session_drivers(t).where("session_name = 'Race' AND d <= 5").selectExpr(
        "session_key", "meeting_key", "concat('Team ', d) AS team_name",
        "cast((6 - d) * 20 + meeting_key AS double) AS points_current",
        "cast((6 - d) * 20 AS double) AS points_start", "d AS position_current", "d AS position_start"))
    empty = c.where("meeting_key = 2 AND team_name = 'Team 1'").withColumn("team_name", F.lit(""))
    json_null = c.where("meeting_key = 5 AND team_name = 'Team 1'").withColumn("team_name", F.lit(None).cast("string"))
    corr = c.where("meeting_key % 4 = 0 AND team_name = 'Team 2'").withColumn(
        "points_current", F.col("points_current") + 0.5)
    return (_raw(c, f, L0).unionByName(_raw(empty, f, L1)).unionByName(_raw(json_null, f, L1))
            .unionByName(_raw(corr, f, L1)))


ENDPOINTS = {
    "car_data": car_data, "championship_drivers": championship_drivers,
    "championship_teams": championship_teams, "drivers": drivers, "intervals": intervals,
    "laps": laps, "location": location, "meetings": meetings, "overtakes": overtakes, "pit": pit,
    "position": position, "race_control": race_control, "session_result": session_result,
    "sessions": sessions, "starting_grid": starting_grid, "stints": stints, "team_radio": team_radio,
    "weather": weather,
}


def raw_tables(t: Tables) -> dict[str, DataFrame]:
    """All 18 RAW endpoint tables (lazy)."""
    return {name: fn(t) for name, fn in ENDPOINTS.items()}
