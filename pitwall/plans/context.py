"""One object that wires driver tables → RAW feeds → staging → marts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

import importlib
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Mapping

from pitwall.plans.marts import Marts
from pitwall.plans.quality import observed
from pitwall.plans.staging import MODELS, stage
from pitwall.session import checkpoint_dir
from pitwall.session import materialize as materialize_df
from pitwall.sources.tables import Tables


# Longest builds first (feeds derived from the largest tables), so the
# critical path starts at once and small models fill the gaps.
# Stints and pit share the lap derivation with stg_laps, so they come after
# independent feeds instead of blocking threads while it is built.
BUILD_ORDER = ["stg_laps", "stg_car_data", "stg_location", "stg_position", "stg_race_control",
               "stg_intervals", "stg_stints", "stg_pit", "stg_weather", "stg_team_radio", "stg_overtakes"]
BUILD_ORDER += [n for n in MODELS if n not in BUILD_ORDER]


class _StagedTables(Mapping):
    """Staging models built on first use and written once as parquet to the
    shared checkpoint folder (one build, many readers)."""

    def __init__(self, ctx: "RaceContext"):
        self.ctx, self._done = ctx, {}
        self._locks = {n: threading.RLock() for n in MODELS}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in MODELS:
            raise KeyError(name)
        with self._locks[name]:
            if name not in self._done:
                model = MODELS[name]
                sessions = self["stg_sessions"] if model.with_year else None
                df = stage(self.ctx.raw_table(model.endpoint), model, sessions)
                self._done[name] = self.ctx.write_checked(df, name) if self.ctx.materialize else df
        return self._done[name]

    def __iter__(self):
        return iter(MODELS)

    def __len__(self):
        return len(MODELS)


class RaceContext:
    """Lazy race data model over the driver tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str, strict_grid: bool = False, materialize: bool = True,
                 land_raw: bool = False):
        self.spark, self.sf_dir = spark, sf_dir
        self.land_raw = land_raw
        self.strict_grid = strict_grid
        self.materialize = materialize
        self.counted: dict[str, dict[str, int]] = {}        # null counts by table and column
        self.tables = Tables(spark, sf_dir, (lambda df, name: materialize_df(df, f"_derived_{name}", self.run_dir))
                             if materialize else None)

    @cached_property
    def feeds(self):
        """Where RAW comes from: the race feeds derived from the driver tables."""
        return importlib.import_module("feeds.race")

    @cached_property
    def run_dir(self) -> str:
        return f"{checkpoint_dir(self.spark).rstrip('/')}/pitwall-{uuid.uuid4().hex}"

    def raw_table(self, endpoint: str) -> DataFrame:
        """The RAW (landed) feed of an endpoint; with ``land_raw`` it is written
        once as a VARIANT parquet table, as landing does in production."""
        df = self.feeds.ENDPOINTS[endpoint](self.tables)
        if self.materialize and self.land_raw:
            return self.tables.derived(f"raw_{endpoint}", lambda: df)
        return df

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        return self.feeds.raw_tables(self.tables)

    @cached_property
    def stg(self) -> Mapping[str, DataFrame]:
        return _StagedTables(self)

    @cached_property
    def marts(self) -> Marts:
        mat = self.write_checked if self.materialize else None
        return Marts(self.stg, strict_grid=self.strict_grid, materializer=mat, counted=self.counted)

    def write_checked(self, df: DataFrame, name: str) -> DataFrame:
        """Write a model once; the nulls that its checks forbid are counted by the same job."""
        df, seen = observed(df, name)
        out = materialize_df(df, name, self.run_dir)
        if seen is not None:
            self.counted[name] = seen.get
        return out

    def build(self, threads: int = 4, marts: bool = True) -> None:
        """Build every staging model, then every mart, with ``threads``
        concurrent Spark jobs (independent models share the cluster)."""
        with ThreadPoolExecutor(threads) as pool:
            list(pool.map(lambda n: self.stg[n], BUILD_ORDER))
            if marts:
                list(pool.map(self.marts.get, Marts.NAMES))

    def table(self, name: str) -> DataFrame:
        if name.startswith("stg_"):
            return self.stg[name]
        return self.marts.get(name)
