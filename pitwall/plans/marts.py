"""Marts (M19-M36): dimensions and facts of the star schema, plus the build
that materialises them (S12/S13).

Every fact keeps the natural key ``(session_key, driver_number, …)``; dims
are looked up with plain left joins that AQE turns into broadcast joins
only when the measured dimension is small.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwall.functions import scalars as S
from pitwall.operators.dedupe import keep_first
from pitwall.operators.joins import adjacent_join, enrich, enrich_roles, range_agg, range_join

DRIVER_ATTRS = {"driver_name": "full_name", "driver_acronym": "acronym", "team_name": "team_name"}
SD = ["session_key", "driver_number"]
STINT_BUCKET = 16       # laps: most stints lie in one or two buckets, and so do their partial aggregates


def lossless(x: Column) -> Column:
    """``x`` as a decimal with 12 digits after the point; NULL where that would change it."""
    d = x.try_cast("decimal(38,12)")
    return F.when(d.cast("double") == x, d)


def exact_avg(x: Column) -> Column:
    """Average that does not depend on the order of summation: the exact decimal
    sum over the count where every value fits a decimal unchanged, else ``avg``
    (NaN, infinities, values beyond 26 digits or finer than 12)."""
    d = lossless(x)
    kept = F.when(F.count(d) == F.count(x), F.try_sum(d))
    return F.coalesce(kept.cast("double") / F.count(x), F.avg(x))


def exact_slope(y: Column, x: Column) -> Column:
    """``regr_slope(y, x)`` for whole-numbered ``x``, from exact decimal sums where they fit."""
    both = y.isNotNull() & x.isNotNull()
    d = lossless(y)
    xd = F.when(both, x.cast("decimal(19,0)"))
    yd = F.when(both, d)
    n = F.count(xd)
    top = n * F.try_sum(xd * yd) - F.try_sum(xd) * F.try_sum(yd)
    bottom = n * F.try_sum(xd * xd) - F.try_sum(xd) * F.try_sum(xd)
    exact = F.when(F.count(yd) == n, top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0)))
    return F.coalesce(exact, F.regr_slope(y, x))


def clean_laps(laps: DataFrame, max_s: float = 120.0) -> DataFrame:
    """Not a pit-out lap (NULL flag excluded, three-valued) and under ``max_s``."""
    return laps.where((F.col("is_pit_out_lap") == F.lit(False)) & (F.col("lap_duration_s") < max_s))


def _mart(fn):
    """Build a mart once (thread-safe); with a materializer it is written as a
    table and every reader, including other marts, reads the files."""
    name = fn.__name__

    def get(self):
        with self._lock(name):
            if name not in self._memo:
                df = fn(self)
                self._memo[name] = self._materializer(df, name) if self._materializer else df
        return self._memo[name]
    get.__doc__ = fn.__doc__
    return property(get)


class Marts:
    """Lazily built marts over a mapping of staging DataFrames."""

    def __init__(self, stg: Mapping[str, DataFrame], strict_grid: bool = False,
                 materializer: Callable[[DataFrame, str], DataFrame] | None = None,
                 counted: Mapping[str, Mapping[str, int]] | None = None):
        self.stg = stg
        self.counted = counted if counted is not None else {}     # null counts observed while writing
        self.strict_grid = strict_grid
        self._materializer = materializer
        self._memo: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.RLock] = {}
        self._guard = threading.Lock()

    def _lock(self, name: str) -> threading.RLock:
        with self._guard:
            return self._locks.setdefault(name, threading.RLock())

    def _s(self, name: str) -> DataFrame:
        return self.stg[name].drop("loaded_at")

    # ------------------------------------------------------------------ dims
    @_mart
    def dim_meetings(self) -> DataFrame:
        return self._s("stg_meetings")

    @_mart
    def dim_sessions(self) -> DataFrame:
        s = self._s("stg_sessions")
        out = enrich(s, self._s("stg_meetings"), ["meeting_key"], ["meeting_name", "meeting_official_name"])
        return out.select("session_key", "meeting_key", "session_name", "session_type", "circuit_short_name",
                          "country_name", "location", "year", "session_start_at", "session_end_at",
                          "meeting_name", "meeting_official_name")

    @_mart
    def dim_drivers(self) -> DataFrame:
        # staging already keeps one row per (session, driver); the second dedupe is not repeated
        return self._s("stg_drivers")

    @_mart
    def dim_championship_drivers(self) -> DataFrame:
        return self._s("stg_championship_drivers")

    @_mart
    def dim_championship_teams(self) -> DataFrame:
        return self._s("stg_championship_teams")

    def _drivers(self, fact: DataFrame) -> DataFrame:
        return enrich(fact, self.dim_drivers, SD, DRIVER_ATTRS)

    # ------------------------------------------------------------------ simple facts
    @_mart
    def fct_car_data(self) -> DataFrame:
        return self._drivers(self._s("stg_car_data"))

    @_mart
    def fct_intervals(self) -> DataFrame:
        return self._drivers(self._s("stg_intervals"))

    @_mart
    def fct_location(self) -> DataFrame:
        return self._drivers(self._s("stg_location"))

    @_mart
    def fct_overtakes(self) -> DataFrame:
        roles = {
            "driver_overtaking": {"driver_overtaking_name": "full_name",
                                  "driver_overtaking_acronym": "acronym", "team_overtaking": "team_name"},
            "driver_overtaken": {"driver_overtaken_name": "full_name",
                                 "driver_overtaken_acronym": "acronym", "team_overtaken": "team_name"},
        }
        return enrich_roles(self._s("stg_overtakes"), self.dim_drivers, "driver_number", roles, on=["session_key"])

    @_mart
    def fct_race_control(self) -> DataFrame:
        rc = self._s("stg_race_control")
        out = enrich(rc, self.dim_sessions, ["session_key"], ["session_name", "circuit_short_name", "country_name"])
        out = enrich(out, self.dim_drivers, SD, {"driver_name": "full_name", "driver_acronym": "acronym"})
        return out.select("session_key", "recorded_at", "category", "flag", "lap_number", "message", "scope",
                          "sector", "driver_number", "driver_name", "driver_acronym", "session_name",
                          "circuit_short_name", "country_name")

    @_mart
    def fct_starting_grid(self) -> DataFrame:
        g = self._s("stg_starting_grid").select("session_key", "driver_number", "grid_position")
        out = self._drivers(g)
        return enrich(out, self.dim_sessions, ["session_key"], ["meeting_name", "session_name", "year"])

    @_mart
    def fct_team_radio(self) -> DataFrame:
        out = self._drivers(self._s("stg_team_radio"))
        return enrich(out, self.dim_sessions, ["session_key"], ["meeting_name", "session_name", "year"])

    @_mart
    def fct_weather(self) -> DataFrame:
        return enrich(self._s("stg_weather"), self.dim_sessions, ["session_key"],
                      ["session_name", "circuit_short_name", "country_name", "session_start_at"])

    # ------------------------------------------------------------------ interval facts
    def _stints(self) -> DataFrame:
        return self._s("stg_stints").select(*SD, "stint_number", "lap_start", "lap_end", "tyre_compound",
                                            "tyre_age_at_start")

    @_mart
    def fct_laps(self) -> DataFrame:
        """Each lap gets the tyre context of the lowest-numbered stint whose
        closed lap range contains it (range join on (session, driver, lap))."""
        laps = self._s("stg_laps")
        joined = range_join(laps, self._stints(), SD, "lap_number", "lap_start", "lap_end", how="left",
                            width=STINT_BUCKET, first_by=[F.col("stint_number").asc_nulls_last()])
        out = joined.withColumn("tyre_age_on_lap",
                                S.tyre_age_on_lap("lap_number", "lap_start", "tyre_age_at_start"))
        out = out.select(*laps.columns, "tyre_compound", "tyre_age_at_start", "tyre_age_on_lap")
        return self._drivers(out)

    @_mart
    def fct_stints(self) -> DataFrame:
        """Per stint: length, clean-lap count, best / mean / spread, end-point
        degradation and regression slope of lap time on lap number."""
        cl = clean_laps(self._s("stg_laps")).select(*SD, "lap_number", "lap_duration_s")
        dur, lap = F.col("lap_duration_s"), F.col("lap_number")
        lo, hi = F.col("lap_start"), F.col("lap_end")
        end_delta = (F.max(F.when(lap == hi, dur)) - F.min(F.when(lap == lo, dur)))
        aggs = [
            F.count(lap).alias("clean_laps"),
            F.min(dur).alias("fastest_lap_s"),
            exact_avg(dur).alias("avg_lap_time_s"),
            (exact_avg(dur) - F.min(dur)).alias("gap_to_best_s"),
            F.round(end_delta / F.nullif(hi - lo, F.lit(0)), 3).alias("deg_per_lap_s"),
            F.round(exact_slope(dur, lap), 3).alias("deg_slope_s"),
        ]
        keys = [*SD, "stint_number", "tyre_compound", "tyre_age_at_start", "lap_start", "lap_end"]
        st = range_agg(self._stints(), cl, SD, "lap_number", "lap_start", "lap_end", aggs,
                       width=STINT_BUCKET, group_cols=keys)
        st = st.select(*keys[:-2], "lap_start", "lap_end", (hi - lo + 1).alias("stint_length"), "clean_laps",
                       "fastest_lap_s", "avg_lap_time_s", "gap_to_best_s", "deg_per_lap_s", "deg_slope_s")
        st = st.select(*SD, "stint_number", "tyre_compound", "tyre_age_at_start", "lap_start", "lap_end",
                       "stint_length", "clean_laps", "fastest_lap_s", "avg_lap_time_s", "gap_to_best_s",
                       "deg_per_lap_s", "deg_slope_s")
        return self._drivers(st)

    @_mart
    def fct_pit_stops(self) -> DataFrame:
        """Tyre out (stint ending on the pit lap) and in (stint starting on the next lap)."""
        p = self._s("stg_pit")
        out = adjacent_join(p, self._stints(), SD, "lap_number", "lap_start", "lap_end",
                            before={"tyre_compound_out": "tyre_compound", "stint_number": "stint_number"},
                            after={"tyre_compound_in": "tyre_compound"})
        out = out.select(*SD, "lap_number", "pit_duration_s", "pit_at", "tyre_compound_out", "tyre_compound_in",
                         "stint_number")
        out = self._drivers(out)
        return keep_first(out, [*SD, "lap_number"], [F.col("stint_number").asc_nulls_last(),
                                                     F.col("tyre_compound_in").asc_nulls_last()])

    # ------------------------------------------------------------------ results
    def _earliest_grid(self) -> DataFrame:
        """The grid row of the earliest session per (meeting, driver)."""
        g = self._s("stg_starting_grid")
        return keep_first(g, ["meeting_key", "driver_number"], [F.col("session_key").asc()]) \
            .select("meeting_key", "driver_number", "grid_position")

    @_mart
    def fct_session_results(self) -> DataFrame:
        r = self._s("stg_session_result").drop("classified_position")
        s = self._s("stg_sessions").select("session_key", "meeting_key", "session_type")
        out = r.join(s, ["session_key"], "left").join(self._earliest_grid(), ["meeting_key", "driver_number"], "left")
        out = out.select(
            *SD, "finish_position", "points", "is_dnf", "is_dns", "is_dsq", "laps_completed", "race_duration_s",
            "gap_to_leader",
            S.classify_result("is_dsq", "is_dns", "is_dnf", "finish_position", "laps_completed")
            .alias("classified_position"),
            "session_type", "grid_position",
            S.positions_gained("finish_position", "grid_position", "session_type").alias("positions_gained"))
        return self._drivers(out)

    def session_to_quali(self) -> DataFrame:
        """Race session → every qualifying/shootout session of its meeting (left)."""
        s = self._s("stg_sessions")
        race = s.where(F.col("session_type") == "Race").select(
            F.col("session_key").alias("race_session_key"), "meeting_key")
        quali = s.where(F.col("session_type").isin("Qualifying", "Shootout")).select(
            F.col("session_key").alias("quali_session_key"), "meeting_key")
        return race.join(quali, ["meeting_key"], "left").drop("meeting_key")

    @_mart
    def fct_race_positions(self) -> DataFrame:
        """Positions with grid, result and places gained.

        Parity mode looks the grid up in every qualifying session of the
        meeting (a meeting with two fans rows out); ``strict_grid`` uses the
        earliest grid row per meeting and driver instead.
        """
        p = self._drivers(self._s("stg_position"))
        if self.strict_grid:
            s = self._s("stg_sessions").select("session_key", "meeting_key")
            p = p.join(s, ["session_key"], "left").join(self._earliest_grid(), ["meeting_key", "driver_number"],
                                                        "left").drop("meeting_key")
        else:
            sq = self.session_to_quali().withColumnRenamed("race_session_key", "session_key")
            grid = self._s("stg_starting_grid").select(F.col("session_key").alias("quali_session_key"),
                                                      "driver_number", "grid_position")
            p = p.join(sq, ["session_key"], "left").join(grid, ["quali_session_key", "driver_number"], "left")
        r = self._s("stg_session_result").select(*SD, "finish_position", "points", "classified_position")
        p = p.join(r, SD, "left")
        return p.select(*SD, "position", "recorded_at", "driver_name", "driver_acronym", "team_name",
                        "grid_position", "finish_position", "points", "classified_position",
                        (F.col("finish_position") - F.col("grid_position")).alias("positions_gained"))

    # ------------------------------------------------------------------ build
    NAMES = ("dim_meetings", "dim_sessions", "dim_drivers", "dim_championship_drivers",
             "dim_championship_teams", "fct_car_data", "fct_intervals", "fct_laps", "fct_location",
             "fct_overtakes", "fct_pit_stops", "fct_race_control", "fct_race_positions",
             "fct_session_results", "fct_starting_grid", "fct_stints", "fct_team_radio", "fct_weather")

    def get(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        return getattr(self, name)

    def all(self) -> dict[str, DataFrame]:
        return {n: self.get(n) for n in self.NAMES}


FACT_PARTITION = "session_key"


def build_marts(marts: Marts, out_dir: str, names: tuple[str, ...] | None = None,
                mode: str = "overwrite") -> dict[str, str]:
    """Materialise marts as parquet tables (facts partitioned by session).

    ``mode='dynamic'`` rewrites only the session partitions present in the
    new data (incremental refresh). Returns ``{name: path}``. Written tables
    also cut lineage: readers start from files, not from the staging plan.
    """
    paths = {}
    for n in names or marts.NAMES:
        df = marts.get(n)
        path = f"{out_dir.rstrip('/')}/{n}"
        w = df.write
        if n.startswith("fct_"):
            # REBALANCE (not repartition): AQE splits a hot session over several
            # writer tasks and coalesces small ones, so files stay near target size
            df = df.hint("rebalance", FACT_PARTITION)
            w = df.write.partitionBy(FACT_PARTITION)
        if mode == "dynamic":
            w = w.option("partitionOverwriteMode", "dynamic").mode("overwrite")
        else:
            w = w.mode(mode)
        w.parquet(path)
        paths[n] = path
    return paths
