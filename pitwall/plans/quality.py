"""Declarative data-quality checks with severities.

``not_null`` checks of a table are counted while it is written (``observed``),
so the report does not read it again; of a table that is not written, one
aggregate pass evaluates them all at once. ``unique`` checks (single or composite keys) are a grouped count of
duplicated key values, NULL keys ignored. The report is one row per check:
``(table_name, column_name, test, severity, failures, status)``; only
``error`` checks fail the run when ``raise_on_error``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    table: str
    columns: tuple[str, ...]
    test: str                 # not_null | unique
    severity: str = "error"   # error | warn


def not_null(table: str, *cols: str, severity: str = "error") -> list[Check]:
    return [Check(table, (c,), "not_null", severity) for c in cols]


def unique(table: str, *cols: str, severity: str = "error") -> list[Check]:
    return [Check(table, tuple(cols), "unique", severity)]


# Declared checks on the marts and staging models.
CHECKS: list[Check] = [
    *not_null("dim_drivers", "session_key", "driver_number", "full_name"),
    *not_null("dim_drivers", "team_name", severity="warn"),
    *not_null("dim_sessions", "session_key", "session_name"), *unique("dim_sessions", "session_key"),
    *not_null("fct_laps", "session_key", "driver_number", "lap_number", "lap_duration_s"),
    *not_null("fct_pit_stops", "session_key", "driver_number"),
    *not_null("fct_pit_stops", "pit_duration_s", severity="warn"),
    *not_null("fct_race_positions", "session_key", "driver_number", "position"),
    *not_null("fct_stints", "session_key", "driver_number", "stint_number", "tyre_compound"),
    *not_null("fct_session_results", "session_key", "driver_number"),
    *not_null("fct_overtakes", "session_key", "driver_overtaking", "driver_overtaken"),
    *not_null("fct_intervals", "session_key", "driver_number", "recorded_at"),
    *not_null("fct_weather", "session_key", "recorded_at"),
    *not_null("fct_race_control", "session_key", "recorded_at", "message"),
    *not_null("fct_car_data", "session_key", "driver_number", "recorded_at"),
    *not_null("fct_location", "session_key", "driver_number", "recorded_at"),
    *not_null("dim_championship_drivers", "driver_number", "session_key", "championship_position"),
    *not_null("dim_championship_teams", "team_name", "session_key", "championship_position"),
    *not_null("stg_meetings", "meeting_key"), *unique("stg_meetings", "meeting_key"),
    *not_null("stg_championship_drivers", "driver_number", "session_key"),
    *not_null("stg_championship_teams", "team_name", "session_key"),
    *not_null("stg_sessions", "session_key"), *unique("stg_sessions", "session_key"),
]


def observed(df: DataFrame, table: str, checks: Sequence[Check] = CHECKS) -> tuple[DataFrame, Observation | None]:
    """``df`` with its null counts observed by whatever job runs it first; (df, None) without a check on nulls."""
    cols = dict.fromkeys(c.columns[0] for c in checks if c.table == table and c.test == "not_null")
    if not cols:
        return df, None
    seen = Observation()
    return df.observe(seen, *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]), seen


def failing_keys(tables: Mapping[str, DataFrame], checks: Sequence[Check] = CHECKS, keys: Sequence[str] = (
        "meeting_key", "session_key", "driver_number"), counted: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """(table_name, column_name, test, key, n): the keys of rows that fail a check, with their number.

    ``key`` is a JSON object of those of ``keys`` that the table has. Tables
    whose counts say that nothing failed are not read.
    """
    parts = []
    for c in checks:
        if c.test == "not_null" and not (counted or {}).get(c.table, {}).get(c.columns[0], 1):
            continue
        df = tables[c.table]
        if c.test == "not_null":
            bad = df.where(F.col(c.columns[0]).isNull())
        else:
            dup = df.dropna(subset=list(c.columns)).groupBy(*c.columns).count().where("count > 1").drop("count")
            bad = df.join(dup, list(c.columns), "left_semi")
        key = F.to_json(F.struct(*[k for k in keys if k in df.columns]), {"ignoreNullFields": "false"})
        parts.append(bad.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(c.table).alias("table_name"), F.lit(",".join(c.columns)).alias("column_name"),
            F.lit(c.test).alias("test"), "key", "n"))
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame(
            [], "table_name string, column_name string, test string, key string, n long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_checks(tables: Mapping[str, DataFrame], checks: Sequence[Check] = CHECKS,
               counted: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """The report; ``counted`` has the null counts (table, column) that were observed while tables were written."""
    by_table: dict[str, list[Check]] = defaultdict(list)
    for c in checks:
        by_table[c.table].append(c)
    parts: list[DataFrame] = []
    for tname, cs in by_table.items():
        df = tables[tname]
        nn = [c for c in cs if c.test == "not_null"]
        known = (counted or {}).get(tname)
        if nn and known is not None and all(c.columns[0] in known for c in nn):
            rows = [(tname, c.columns[0], "not_null", c.severity, int(known[c.columns[0]])) for c in nn]
            parts.append(df.sparkSession.createDataFrame(
                rows, "table_name string, column_name string, test string, severity string, failures long"))
        elif nn:
            counts = df.agg(*[F.count_if(F.col(c.columns[0]).isNull()).alias(f"_c{i}") for i, c in enumerate(nn)])
            rows = F.array(*[F.struct(F.lit(c.columns[0]).alias("column_name"), F.lit(c.severity).alias("severity"),
                                      F.col(f"_c{i}").alias("failures")) for i, c in enumerate(nn)])
            parts.append(counts.select(F.explode(rows).alias("r")).select(
                F.lit(tname).alias("table_name"), "r.column_name", F.lit("not_null").alias("test"),
                "r.severity", "r.failures"))
        for c in (c for c in cs if c.test == "unique"):
            keys = list(c.columns)
            present = F.lit(True)
            for k in keys:
                present = present & F.col(k).isNotNull()
            dup = df.where(present).groupBy(*keys).count().where(F.col("count") > 1)
            parts.append(dup.agg(F.count(F.lit(1)).alias("failures")).select(
                F.lit(tname).alias("table_name"), F.lit(",".join(keys)).alias("column_name"),
                F.lit("unique").alias("test"), F.lit(c.severity).alias("severity"), "failures"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("failures") == 0, "pass")
                          .when(F.col("severity") == "warn", "warn").otherwise("fail"))


def assert_checks(report: DataFrame) -> DataFrame:
    """Raise when an ``error`` check failed. The report has one row per
    declared check (a few dozen), so reading its failing rows is bounded."""
    failed = report.where(F.col("status") == "fail").select("table_name", "column_name", "test", "failures").collect()
    if failed:
        raise AssertionError("data-quality errors: " + "; ".join(
            f"{r.table_name}.{r.column_name} {r.test} ×{r.failures}" for r in failed))
    return report
