"""Incremental refresh (S13) and the load manifest."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from compare import canon
from conftest import SF_SMALL
from pitwall.functions.variant import extract
from pitwall.plans import refresh
from pitwall.plans.context import RaceContext
from pitwall.plans.marts import Marts
from pitwall.plans.staging import MODELS
from pitwall.sources.landing import LoadManifest, parse_records

MARTS = ("dim_sessions", "dim_championship_drivers", "fct_laps", "fct_stints", "fct_session_results",
         "fct_race_positions", "fct_starting_grid")


def files(store, mart):
    """{session: data files} of a mart as it lies on disk."""
    root = f"{store.base}/marts/{mart}".removeprefix("file:")
    return {d: sorted(f for f in os.listdir(f"{root}/{d}") if f.endswith(".parquet"))
            for d in os.listdir(root) if d.startswith("session_key=")}


@pytest.fixture(scope="module")
def built(spark):
    ctx = RaceContext(spark, SF_SMALL, land_raw=True)
    raw = {MODELS[n].endpoint: ctx.raw_table(MODELS[n].endpoint) for n in refresh.sources_of(MARTS)}
    return ctx, raw


def corrections(raw):
    """A batch that touches every kind of reach: (records landed first, records sent later)."""
    sk = extract("session_key", "int")
    late = {"laps": sk == 11, "stints": sk == 23, "starting_grid": sk == 32, "session_result": sk == 45, "drivers": sk == 51,
            "sessions": sk.isin(62, 63), "meetings": extract("meeting_key", "int") == 7}
    first = {e: df.where(~F.coalesce(late[e], F.lit(False))) if e in late and e not in ("sessions", "meetings", "drivers")
             else df.where("loaded_at = timestamp_ntz'2024-01-01 00:00:00'") if e in late else df for e, df in raw.items()}
    batch = {e: raw[e].where(late[e]) if e not in ("sessions", "meetings", "drivers") else
             raw[e].where("loaded_at > timestamp_ntz'2024-01-01 00:00:00'") for e in late}
    return first, batch


def test_refresh_equals_full_build_and_touches_only_reached_sessions(spark, built):
    ctx, raw = built
    first, batch = corrections(raw)
    # sessions, drivers and meetings: only two sessions' corrections come with this batch, the others before
    sk, mk = extract("session_key", "int"), extract("meeting_key", "int")
    for e, mine in (("sessions", sk.isin(63, 70)), ("drivers", sk == 51), ("meetings", mk == 11)):
        first[e] = first[e].unionByName(batch[e].where(~mine))
        batch[e] = batch[e].where(mine)
    store = refresh.MartStore(spark, tempfile.mkdtemp(prefix="pw-refresh-"), MARTS)
    store.build(first)
    old = {m: files(store, m) for m in MARTS if m.startswith("fct_")}
    reached = store.refresh(batch)
    for m in MARTS:
        want = ctx.marts.get(m)
        rows = [tuple(r) for r in store.mart(m).select(*want.columns).collect()]
        assert canon(want.columns, rows) == canon(want.columns, [tuple(r) for r in want.collect()]), m
    for m, before in old.items():
        keys = {f"session_key={r[0]}" for r in reached[m].collect()} if m in reached else set()
        now = files(store, m)
        assert all(now[d] == before[d] for d in before if d not in keys), m
        assert all(now[d] != before.get(d) for d in now if d in keys), m
    assert {r[0] for r in reached["fct_stints"].collect()} == {11, 23, 51}
    grid = {r[0] for r in reached["fct_session_results"].collect()}
    assert {31, 32, 33, 34, 35, 51} <= grid and not grid & {11, 23}       # siblings of the late grid's session


def test_refresh_twice_changes_nothing(spark, built):
    _, raw = built
    first, batch = corrections(raw)
    store = refresh.MartStore(spark, tempfile.mkdtemp(prefix="pw-refresh-"), ("fct_stints", "dim_championship_drivers"))
    few = {e: raw[e] for e in raw}
    store.build(few)
    once = canon(store.mart("fct_stints").columns, [tuple(r) for r in store.mart("fct_stints").collect()])
    store.refresh({e: batch[e] for e in ("laps", "stints", "sessions")})
    assert canon(store.mart("fct_stints").columns, [tuple(r) for r in store.mart("fct_stints").collect()]) == once


def test_reach_names_every_fact_and_source():
    facts = {m for m in Marts.NAMES if m.startswith("fct_")}
    assert set(refresh.REACH) == facts and set(refresh.DIM_SOURCES) == set(Marts.NAMES) - facts
    assert {s for r in refresh.REACH.values() for s in r} | {s for v in refresh.DIM_SOURCES.values() for s in v} == set(MODELS)


def record_lines(spark, ids):
    return parse_records(spark.createDataFrame([(f'{{"session_key": {k}, "n": {n}}}',) for k, n in ids], "value string"),
                         "laps")[0]


def manifest(spark):
    base = tempfile.mkdtemp(prefix="pw-manifest-")
    return LoadManifest(spark, f"{base}/raw", f"{base}/manifest")


def numbers(spark, m):
    return sorted(r[0] for r in spark.read.parquet(m.raw_dir).select(extract("n", "int")).collect())


def test_manifest_guards_loads_without_reading_raw(spark):
    m = manifest(spark)
    m.load(record_lines(spark, [(1, 1), (1, 2), (2, 3), ("null", 4)]))
    m.load(record_lines(spark, [(1, 5), (3, 6), ("null", 7)]))
    assert numbers(spark, m) == [1, 2, 3, 4, 6]
    left = m.new_records(record_lines(spark, [(2, 8), (4, 9), ("null", 10)]))
    assert [r[0] for r in left.select(extract("n", "int")).collect()] == [9]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert not any(m.raw_dir in f for f in left.inputFiles()) and "manifest" in str(left.inputFiles()) and plan


def test_manifest_lost_or_cut_short(spark):
    m = manifest(spark)
    m.load(record_lines(spark, [(1, 1), (2, 2)]))
    m.rebuild()
    assert {r["session_key"] for r in m.landed().collect()} == {"1", "2"}
    # a load that died: announced, half of it in RAW, never recorded as landed
    keys = m.keys_of(record_lines(spark, [(3, 3), (4, 4)]))
    m._append(keys, "died", "announced")
    from pitwall.sources.landing import write_raw
    write_raw(record_lines(spark, [(3, 3)]), m.raw_dir)
    m.load(record_lines(spark, [(3, 3), (4, 4)]))
    assert numbers(spark, m) == [1, 2, 3, 4]
    assert m.cut_short().count() == 0


def test_manifest_load_that_died_before_raw(spark):
    m = manifest(spark)
    m.load(record_lines(spark, [(1, 1)]))
    m._append(m.keys_of(record_lines(spark, [(9, 9)])), "died", "announced")
    m.load(record_lines(spark, [(9, 9)]))
    assert numbers(spark, m) == [1, 9] and m.cut_short().count() == 0
