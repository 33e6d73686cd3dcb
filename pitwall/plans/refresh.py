"""Incremental refresh of staged tables and marts.

A batch of RAW records changes some natural keys. What each change reaches is
declared once (``REACH``): most staged tables reach the sessions of their own
records; a grid or session record also reaches the sibling sessions of its
meeting, a meeting record all of its sessions. ``MartStore.refresh`` merges
the batch into the staged tables, rebuilds every mart from the staged rows of
the reached sessions alone, and overwrites only those sessions' partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall.functions.variant import project_variant
from pitwall.plans.marts import FACT_PARTITION, Marts, build_marts
from pitwall.plans.staging import MODELS, stage
from pitwall.session import materialize
from pitwall.streaming.ingest import upsert_latest

SESSION, MEETING = "its own session", "every session of its meeting"
_DRIVER_FACT = {"stg_drivers": SESSION}
_SESSION_FACT = {"stg_sessions": SESSION}
REACH: dict[str, dict[str, str]] = {
    "fct_car_data": {"stg_car_data": SESSION, **_DRIVER_FACT},
    "fct_intervals": {"stg_intervals": SESSION, **_DRIVER_FACT},
    "fct_location": {"stg_location": SESSION, **_DRIVER_FACT},
    "fct_overtakes": {"stg_overtakes": SESSION, **_DRIVER_FACT},
    "fct_race_control": {"stg_race_control": SESSION, **_DRIVER_FACT, **_SESSION_FACT},
    "fct_starting_grid": {"stg_starting_grid": SESSION, "stg_meetings": MEETING, **_DRIVER_FACT, **_SESSION_FACT},
    "fct_team_radio": {"stg_team_radio": SESSION, "stg_meetings": MEETING, **_DRIVER_FACT, **_SESSION_FACT},
    "fct_weather": {"stg_weather": SESSION, **_SESSION_FACT},
    "fct_laps": {"stg_laps": SESSION, "stg_stints": SESSION, **_DRIVER_FACT},
    "fct_stints": {"stg_laps": SESSION, "stg_stints": SESSION, **_DRIVER_FACT},
    "fct_pit_stops": {"stg_pit": SESSION, "stg_stints": SESSION, **_DRIVER_FACT},
    "fct_session_results": {"stg_session_result": SESSION, "stg_starting_grid": MEETING, **_DRIVER_FACT, **_SESSION_FACT},
    "fct_race_positions": {"stg_position": SESSION, "stg_session_result": SESSION, "stg_starting_grid": MEETING,
                           "stg_sessions": MEETING, **_DRIVER_FACT},
}
# Dimensions have no partitions; they are small and written whole when a source changes.
DIM_SOURCES = {"dim_meetings": ("stg_meetings",), "dim_sessions": ("stg_sessions", "stg_meetings"),
               "dim_drivers": ("stg_drivers",), "dim_championship_drivers": ("stg_championship_drivers", "stg_sessions"),
               "dim_championship_teams": ("stg_championship_teams", "stg_sessions")}
# Looked up across sessions, so never limited to the reached ones.
ACROSS = {"fct_session_results": {"stg_starting_grid"}, "fct_race_positions": {"stg_starting_grid"}}
WHOLE = {"stg_sessions", "stg_meetings"}


def within(df: DataFrame, keys: DataFrame, key: str = FACT_PARTITION) -> DataFrame:
    """Rows whose key (null included) is among ``keys``."""
    k = keys.select(F.col(key).alias("_reached")).distinct()
    return df.join(k, F.col(key).eqNullSafe(F.col("_reached")), "left_semi")


def sources_of(marts: tuple[str, ...]) -> list[str]:
    """Staged tables that some of ``marts`` read, dimensions' ones included; sessions first (they date others)."""
    read = {s for m in marts for s in (*REACH.get(m, {}), *DIM_SOURCES.get(m, ()))} | {"stg_drivers", *WHOLE}
    return sorted(read, key=lambda s: (s != "stg_sessions", s))


class _Reached(Mapping):
    """Staged tables as one mart's rebuild needs them: the reached sessions' rows."""

    def __init__(self, staged, mart: str, reached: DataFrame):
        self.staged, self.mart, self.reached = staged, mart, reached

    def __getitem__(self, name: str) -> DataFrame:
        df = self.staged(name)
        return df if name in WHOLE | ACROSS.get(self.mart, set()) else within(df, self.reached)

    def __iter__(self) -> Iterator[str]:
        return iter(MODELS)

    def __len__(self) -> int:
        return len(MODELS)


class MartStore:
    """Staged tables and marts under one folder, both partitioned by session (meetings by meeting)."""

    def __init__(self, spark: SparkSession, base: str, marts: tuple[str, ...] = Marts.NAMES, strict_grid: bool = False):
        self.spark, self.base, self.names, self.strict_grid = spark, base.rstrip("/"), tuple(marts), strict_grid

    def _folder(self, name: str) -> str:
        return f"{self.base}/staged/{name}"

    def staged(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(name))

    def mart(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/marts/{name}")

    def build(self, raw: Mapping[str, DataFrame]) -> None:
        """Everything from RAW (by endpoint)."""
        for name in sources_of(self.names):
            model = MODELS[name]
            sessions = self.staged("stg_sessions") if model.with_year else None
            key = model.keys[0]
            stage(raw[model.endpoint], model, sessions).hint("rebalance", key).write.mode("overwrite") \
                .partitionBy(key).parquet(self._folder(name))
        tables = {n: self.staged(n) for n in sources_of(self.names)}
        build_marts(Marts(tables, self.strict_grid), f"{self.base}/marts", self.names)

    def refresh(self, batch: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Merge newly landed RAW records (by endpoint) and rebuild what they reach.

        Returns the reached sessions per rebuilt fact. Merging is
        latest-wins, so a batch that is sent again changes nothing.
        """
        changed = {n: m for n, m in MODELS.items() if n in sources_of(self.names) and m.endpoint in batch}
        keys = {n: materialize(project_variant(batch[m.endpoint], m.spec).select(m.keys[0]).distinct(), f"changed_{n}")
                for n, m in changed.items()}
        before = self._meetings(keys)
        for name in sorted(changed, key=lambda s: s != "stg_sessions"):
            model = changed[name]
            upsert_latest(self.spark, batch[model.endpoint], model, self._folder(name),
                          sessions=self.staged("stg_sessions") if model.with_year else None)
        if "stg_sessions" in changed:
            self._date_again(keys["stg_sessions"])
        siblings = before.unionByName(self._meetings(keys)).distinct()
        reached = {m: materialize(self._reached(m, keys, siblings), f"reached_{m}") for m in self.names
                   if any(s in keys for s in REACH.get(m, ()))}
        for mart, sessions in reached.items():
            part = Marts(_Reached(self.staged, mart, sessions), self.strict_grid)
            build_marts(part, f"{self.base}/marts", (mart,), mode="dynamic")
        dims = tuple(m for m in self.names if any(s in keys for s in DIM_SOURCES.get(m, ())))
        if dims:
            build_marts(Marts({n: self.staged(n) for n in sources_of(dims)}), f"{self.base}/marts", dims)
        return reached

    def _meetings(self, keys: Mapping[str, DataFrame]) -> DataFrame:
        """(source, session_key): the sessions of the meetings that changed records are in, as staged now."""
        sessions = self.staged("stg_sessions").select(FACT_PARTITION, "meeting_key")
        found = [self.spark.createDataFrame([], f"source string, {FACT_PARTITION} int")]
        for name, changed in keys.items():
            if not any(r.get(name) == MEETING for r in REACH.values()):
                continue
            meetings = changed if name == "stg_meetings" else within(sessions, changed).select("meeting_key")
            if name == "stg_starting_grid":     # a grid record names a meeting of its own
                meetings = meetings.unionByName(within(self.staged(name), changed).select("meeting_key"))
            found.append(within(sessions, meetings, "meeting_key").select(F.lit(name).alias("source"), FACT_PARTITION))
        return materialize(reduce(DataFrame.unionByName, found), "siblings")

    def _reached(self, mart: str, keys: Mapping[str, DataFrame], siblings: DataFrame) -> DataFrame:
        parts = [siblings.where(F.col("source").isin([s for s, r in REACH[mart].items() if r == MEETING and s in keys]))
                 .select(FACT_PARTITION)]
        parts += [keys[s].select(FACT_PARTITION) for s in REACH[mart] if s in keys and s != "stg_meetings"]
        return reduce(DataFrame.unionByName, parts).distinct()

    def _date_again(self, sessions: DataFrame) -> None:
        """Season years of staged rows follow a corrected session."""
        years = self.staged("stg_sessions").select(F.col(FACT_PARTITION).alias("_s"), "year")
        for name in sources_of(self.names):
            if MODELS[name].with_year:
                old = within(self.staged(name), sessions)
                dated = old.drop("year").join(years, F.col(FACT_PARTITION) == F.col("_s"), "left").select(*old.columns)
                materialize(dated, f"dated_{name}").write.mode("overwrite").option(
                    "partitionOverwriteMode", "dynamic").partitionBy(FACT_PARTITION).parquet(self._folder(name))
