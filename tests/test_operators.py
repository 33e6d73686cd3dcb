"""Edge rows per operator (null, tie, empty interval, boundary)."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitwall.functions import scalars as S
from pitwall.functions.variant import Require, extract, raw_path
from pitwall.operators import (adjacent_join, asof_join, gap_fill_linear, last_non_null, latest_per_key, locate,
                               range_agg, range_join, resample_linear, seq_index)
from pitwall.plans.quality import Check, run_checks


def T(s):
    return dt.datetime.fromisoformat(s)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_latest_per_key_ties_nulls_versions(spark):
    df = spark.createDataFrame(
        [(1, "a", T("2024-01-01 00:00:00")), (1, "b", T("2024-01-02 00:00:00")), (1, "c", T("2024-01-03 00:00:00")),
         (2, "x", T("2024-01-01 00:00:00")), (2, "y", T("2024-01-01 00:00:00")),     # tie
         (None, "n", T("2024-01-01 00:00:00")),                                       # null key
         (3, "old", T("2024-01-05 00:00:00")), (3, "nul", None)],                     # null loaded_at wins (DESC NULLS FIRST)
        "k int, v string, loaded_at timestamp")
    out = dict((r.k, r.v) for r in latest_per_key(df, ["k"]).collect())
    assert out[1] == "c" and out[None] == "n" and out[3] == "nul"
    again = dict((r.k, r.v) for r in latest_per_key(df, ["k"]).collect())
    assert again[2] == out[2] and out[2] in ("x", "y")


def test_variant_null_semantics_and_numeric_kinds(spark):
    df = spark.sql("""SELECT parse_json(j) AS raw_data FROM VALUES
        ('{"x": 12.5}'), ('{"x": "12.5"}'), ('{"x": "+1 LAP"}'), ('{"x": [1.5, null]}'), ('{"x": null}'), ('{}'),
        ('{"x": 12.7}') AS t(j)""")
    got = df.select(raw_path("x").isNotNull().alias("present"), extract("x", "as_double").alias("strict"),
                    extract("x", "try_double").alias("lenient"), extract("x", "string").alias("s")).collect()
    assert [r.present for r in got] == [True, True, True, True, True, False, True]
    assert [r.strict for r in got] == [12.5, None, None, None, None, None, 12.7]
    assert [r.lenient for r in got][:6] == [12.5, 12.5, None, None, None, None]
    assert got[3].s == "[1.5,null]"
    num = spark.sql("""SELECT parse_json(j) AS raw_data FROM VALUES
        ('{"x": 12.5}'), ('{"x": 12.7}'), ('{"x": null}'), ('{}') AS t(j)""")
    assert [r.i for r in num.select(extract("x", "int").alias("i")).collect()] == [13, 13, None, None]
    assert num.where(Require("x").column()).count() == 3                   # JSON null passes the path test
    assert num.where(Require("x", typed="double").column()).count() == 2


def test_range_join_boundaries_overlap_and_nulls(spark):
    pts = spark.createDataFrame([(1, 1), (1, 5), (1, 8), (1, 20), (2, 3)], "k int, p int")
    iv = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 5, 9), (1, 3, None, 9), (2, 4, 4, 2)],
                               "k int, n int, lo int, hi int")
    got = rows(range_join(pts, iv, ["k"], "p", "lo", "hi", first_by=[F.col("n").asc_nulls_last()]), "k", "p")
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 1, 1), (1, 5, 1), (1, 8, 2), (1, 20, None), (2, 3, None)]
    allm = range_join(pts, iv, ["k"], "p", "lo", "hi", how="inner")
    assert allm.where("p = 5").count() == 2                        # closed ends on a shared boundary


def test_range_agg_keeps_empty_intervals(spark):
    pts = spark.createDataFrame([(1, 1, 90.0), (1, 2, 91.0), (1, 3, 93.0)], "k int, p int, v double")
    iv = spark.createDataFrame([(1, 1, 1, 3), (1, 2, 7, 9), (1, 3, 3, 3)], "k int, n int, lo int, hi int")
    out = {r.n: r for r in range_agg(iv, pts, ["k"], "p", "lo", "hi",
                                     [F.count("p").alias("c"), F.regr_slope("v", "p").alias("s")]).collect()}
    assert out[2].c == 0 and out[2].s is None
    assert out[3].c == 1 and out[3].s is None
    assert out[1].c == 3 and out[1].s == pytest.approx(1.5)


def test_adjacent_join_edges(spark):
    ev = spark.createDataFrame([(1, 8), (1, 16), (1, 3)], "k int, lap int")
    iv = spark.createDataFrame([(1, 1, 1, 8), (1, 2, 9, 16)], "k int, n int, lo int, hi int")
    got = adjacent_join(ev, iv, ["k"], "lap", "lo", "hi", {"n_out": "n"}, {"n_in": "n"}).orderBy("lap").collect()
    assert [(r.lap, r.n_out, r.n_in) for r in got] == [(3, None, None), (8, 1, 2), (16, 2, None)]


def test_asof_join_ties_missing_and_tolerance(spark):
    left = spark.createDataFrame([(1, T("2024-01-01 00:00:10")), (1, T("2024-01-01 00:00:05")),
                                  (1, T("2024-01-01 03:00:00")), (2, T("2024-01-01 00:00:00"))],
                                 "k int, ts timestamp_ntz")
    right = spark.createDataFrame([(1, T("2024-01-01 00:00:05"), "a"), (1, T("2024-01-01 00:00:07"), "b"),
                                   (2, T("2024-01-01 00:00:01"), "late")], "k int, rts timestamp_ntz, v string")
    got = {(r.k, r.ts): r.v for r in asof_join(left, right, ["k"], "ts", "rts", bucket_seconds=60).collect()}
    assert got[(1, T("2024-01-01 00:00:05"))] == "a"               # equal time matches
    assert got[(1, T("2024-01-01 00:00:10"))] == "b"
    assert got[(1, T("2024-01-01 03:00:00"))] == "b"               # carried across many empty buckets
    assert got[(2, T("2024-01-01 00:00:00"))] is None               # nothing earlier
    tol = {(r.k, r.ts): r.v for r in asof_join(left, right, ["k"], "ts", "rts", tolerance=60).collect()}
    assert tol[(1, T("2024-01-01 03:00:00"))] is None


def test_asof_join_nulls_never_match(spark):
    left = spark.createDataFrame([(None, T("2024-01-01 00:00:10")), (1, None)], "k int, ts timestamp_ntz")
    right = spark.createDataFrame([(None, T("2024-01-01 00:00:05"), "a"), (1, None, "b")],
                                  "k int, rts timestamp_ntz, v string")
    got = [r.v for r in asof_join(left, right, ["k"], "ts", "rts").collect()]
    assert got == [None, None]


def test_locate_lower_interval_wins_and_gaps_drop(spark):
    pts = spark.createDataFrame([(1, T("2024-01-01 00:01:30")), (1, T("2024-01-01 00:05:00"))],
                                "d int, ts timestamp_ntz")
    laps = spark.createDataFrame([(1, 1, T("2024-01-01 00:00:00"), T("2024-01-01 00:01:30")),
                                  (1, 2, T("2024-01-01 00:01:30"), T("2024-01-01 00:03:00"))],
                                 "d int, lap int, lo timestamp_ntz, hi timestamp_ntz")
    got = locate(pts, laps, ["d"], "ts", "lo", "hi", order=[F.col("lap")]).collect()
    assert [(r.ts, r.lap) for r in got] == [(T("2024-01-01 00:01:30"), 1)]


def test_last_non_null_is_columnwise(spark):
    df = spark.createDataFrame([(1, 1, 10, "a"), (1, 2, None, "b"), (1, 3, 30, None)], "g int, t int, x int, y string")
    r = last_non_null(df, ["g"], F.col("t"), ["x", "y"]).collect()[0]
    assert (r.x, r.y) == (30, "b")


@pytest.mark.parametrize("n,bucket", [(1, None), (2, None), (3, ("i", 2)), (50, None), (50, ("i", 3)), (500, ("i", 1))])
def test_resample_matches_numpy(spark, n, bucket):
    ys = [3.0, None, 7.5, 1.25, 9.0, 9.0, 2.0]
    df = spark.createDataFrame([(1, i, y) for i, y in enumerate(ys)] + [(2, 0, 4.0)], "g int, i int, y double")
    out = resample_linear(df, ["g"], [F.col("i")], "y", n, bucket=bucket).toPandas().sort_values(["g", "point"])
    yv = np.array([0.0 if y is None else y for y in ys])
    exp = np.interp(np.linspace(0, len(yv) - 1, n), np.arange(len(yv)), yv)
    assert np.array_equal(out[out.g == 1]["y"].to_numpy(), exp)
    assert (out[out.g == 2]["y"] == 4.0).all() and len(out[out.g == 2]) == n


@pytest.mark.parametrize("bucket", [None, ("i", 1), ("i", 2), ("i", 3)])
def test_gap_fill_matches_pandas(spark, bucket):
    xs = [None, 1.0, None, None, 4.0, None, None, None, 10.0, None]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "g int, i int, x double")
    out = gap_fill_linear(df, ["g"], [F.col("i")], ["x"], bucket=bucket).orderBy("i").toPandas()
    exp = pd.Series(xs, dtype=float).interpolate().dropna()
    assert out["x"].tolist() == exp.tolist()


def test_classification_every_branch(spark):
    df = spark.createDataFrame([(True, True, True, 1, 5), (False, True, True, 1, 5), (False, False, True, 1, 5),
                                (False, False, False, None, 3), (False, False, False, None, 0),
                                (None, None, None, None, None), (False, False, False, 2, 5)],
                               "dsq boolean, dns boolean, dnf boolean, pos int, laps int")
    got = [r.c for r in df.select(S.classify_result("dsq", "dns", "dnf", "pos", "laps").alias("c")).collect()]
    assert got == ["DSQ", "DNS", "DNF", "DNF", "DNS", "DNS", "Classified"]


def test_add_seconds_exact_and_null(spark):
    df = spark.createDataFrame([(T("2024-01-01 00:00:00"), 89.123456), (T("2024-01-01 00:00:00"), None),
                                (T("2024-01-01 00:00:00"), 1.5)], "ts timestamp_ntz, s double")
    got = df.select(S.add_seconds("ts", "s").alias("e"), S.add_seconds("ts", "s", True).alias("w")).collect()
    assert got[0].e == T("2024-01-01 00:01:29.123456") and got[1].e is None
    assert got[2].w == T("2024-01-01 00:00:02")


def test_formatting(spark):
    df = spark.createDataFrame([(89.7,), (None,), (59.9996,)], "s double")
    got = [r.t for r in df.select(S.format_laptime("s").alias("t")).collect()]
    assert got == ["1:29.700", "—", "0:60.000"]
    assert spark.range(1).select(S.trend_arrow(F.lit(-3)).alias("a")).first().a == "↑ 3"


def test_quality_warn_vs_error(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (None, "y")], "k int, v string")
    rep = {(r.column_name, r.test): r for r in run_checks({"t": df}, [
        Check("t", ("v",), "not_null", "warn"), Check("t", ("k",), "not_null"), Check("t", ("k",), "unique")]).collect()}
    assert rep[("v", "not_null")].status == "warn" and rep[("v", "not_null")].failures == 1
    assert rep[("k", "not_null")].status == "fail"
    assert rep[("k", "unique")].failures == 1


def test_averages_and_slopes_keep_their_values(spark):
    from pitwall.plans.marts import exact_avg, exact_slope
    avg = lambda xs: spark.createDataFrame([(x,) for x in xs], "x double").select(
        exact_avg(F.col("x")).alias("a")).first().a
    assert avg([4e-7, 4e-7]) == 4e-7 and avg([2e12, 4e12]) == 3e12 and np.isnan(avg([float("nan"), 10.0]))
    assert avg([0.1, 0.2, 0.3, None]) == 0.6 / 3 and avg([1e300, 1e300]) == 1e300 and avg([None]) is None
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 5.0), (4, None)], "x int, y double")
    assert df.select(exact_slope(F.col("y"), F.col("x")).alias("s")).first().s == 2.0
    assert df.where("x = 1").select(exact_slope(F.col("y"), F.col("x")).alias("s")).first().s is None


def test_range_join_long_and_open_intervals(spark):
    iv = spark.createDataFrame([(1, "all", 0, 2**31 - 1), (1, "long", 5, 20_000_000), (1, "one", 7, 7), (1, "no", 9, 3),
                                (1, "neg", -10**9, -5)], "k int, name string, lo int, hi int")
    pts = spark.createDataFrame([(1, 7), (1, 20_000_001), (1, -6), (1, None), (2, 7), (1, -1)], "k int, p int")
    got = sorted((r.k, r.p if r.p is not None else 0, r.name or "") for r in range_join(
        pts, iv, ["k"], "p", "lo", "hi").collect())
    assert got == sorted([(1, 7, "all"), (1, 7, "long"), (1, 7, "one"), (1, 20_000_001, "all"), (1, -6, "neg"),
                          (1, 0, ""), (2, 7, ""), (1, -1, "")])
    first = {(r.k, r.p): r.name for r in range_join(pts.dropna(), iv, ["k"], "p", "lo", "hi", first_by=[
        F.col("hi") - F.col("lo")]).collect()}
    assert first == {(1, 7): "one", (1, 20_000_001): "all", (1, -6): "neg", (2, 7): None, (1, -1): None}
    agg = {r.name: r.n for r in range_agg(iv, pts, ["k"], "p", "lo", "hi", [F.count("p").alias("n")]).collect()}
    assert agg == {"all": 2, "long": 1, "one": 1, "no": 0, "neg": 1}


def test_range_join_of_many_rows_takes_more_partitions(spark, monkeypatch):
    """sorted rows per task grew with the tables where the session had few shuffle partitions."""
    from pitwall.operators import joins
    iv = spark.createDataFrame([(k % 3, k, 10 * k, 10 * k + k % 7 * 5_000) for k in range(200)], "k int, i int, lo int, hi int")
    pts = spark.createDataFrame([(n % 3, n, 5 * n) for n in range(400)] + [(None, 400, 7), (1, 401, None)], "k int, n int, p int")
    join = lambda **a: range_join(pts, iv, ["k"], "p", "lo", "hi", first_by=[F.col("i")], point_key=["n"], **a)
    want = sorted((r["n"], r["i"]) for r in join().collect() if r["i"] is not None)
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    few, many = join(), join(rows=402)
    got = [(r["n"], r["i"]) for r in many.collect()]
    assert sorted(x for x in got if x[1] is not None) == want and sorted(n for n, _ in got) == list(range(402))
    sizes = lambda df: {int(n) for n in re.findall(r"hashpartitioning\(.*?(\d+)\)", plan_of(df))}
    assert max(sizes(few)) == 8 and min(sizes(many)) > 16


def test_unmatched_points_stay_on_one_level(spark):
    """a point without a match was sorted once per level."""
    iv = spark.createDataFrame([(1, 7, 7), (1, 500, 20_000_000)], "k int, lo int, hi int")
    pts = spark.createDataFrame([(1, 1), (1, 7), (1, 600), (2, 7)], "k int, p int")
    df = range_join(pts, iv, ["k"], "p", "lo", "hi", first_by=[F.col("lo")])
    assert sorted((r["k"], r["p"], r["lo"]) for r in df.collect() if r["lo"]) == [(1, 7, 7), (1, 600, 500)]
    assert df.count() == 4 and re.search(r"OR \(_lvl#\d+ = 0\)", plan_of(df))


def test_ordinals_of_many_rows_take_more_partitions(spark, monkeypatch):
    """the sort of the laps grew with the table where the session had few shuffle partitions."""
    from pitwall.operators import timeseries
    df = spark.range(3000).select((F.col("id") % 3).alias("s"), (F.col("id") * 7919 % 3001).alias("t"))
    want = sorted((r["s"], r["i"], r["t"]) for r in seq_index(df, ["s"], [F.col("t")], "i", 1, bucket=("t", 100)).collect())
    monkeypatch.setattr(timeseries, "TASK_ROWS", 100)
    out = seq_index(df, ["s"], [F.col("t")], "i", 1, bucket=("t", 100), rows=3000)
    assert sorted((r["s"], r["i"], r["t"]) for r in out.collect()) == want
    assert re.search(r"hashpartitioning\(_part#\d+, 30\)", plan_of(out))


def test_semantic_synonyms_and_samples():
    from pitwall.plans.semantic import MODEL, describe
    assert MODEL.measure("fct_laps", "lap duration").name == "lap_duration_s"
    assert MODEL.measure("fct_pit_stops", "pit stop duration").name == "pit_duration_s"
    with pytest.raises(KeyError):
        MODEL.measure("fct_laps", "top speed")
    assert "SOFT" in describe("fct_laps", "tyre_compound")["sample_values"] and describe("fct_laps")["description"]


def test_positions_of_sessions_without_laps(spark):
    """Samples are numbered per driver in time order where a session has no laps."""
    from types import SimpleNamespace

    from pitwall.plans.queries import positions_per_lap
    pos = spark.createDataFrame(
        [(1, 44, "N", "A", "T", p, T(f"2024-01-01 {h:02d}:00:00"), 3, 1, -2) for h, p in ((3, 2), (1, 5), (7, 1))],
        "session_key int, driver_number int, driver_name string, driver_acronym string, team_name string, position int, "
        "recorded_at timestamp_ntz, grid_position int, finish_position int, positions_gained int")
    laps = spark.createDataFrame([], "session_key int, driver_number int, lap_number int, lap_start_at timestamp_ntz, "
                                     "lap_duration_s double")
    got = positions_per_lap(SimpleNamespace(fct_race_positions=pos, fct_laps=laps)).orderBy("lap").collect()
    assert [(r.lap, r.position, r.total_laps) for r in got] == [(1, 5, 3), (2, 2, 3), (3, 1, 3)]


def test_failed_error_checks_raise_and_warnings_do_not(spark):
    from pitwall.plans.quality import assert_checks
    df = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    assert_checks(run_checks({"t": df}, [Check("t", ("v",), "not_null", "warn"), Check("t", ("k",), "unique")]))
    with pytest.raises(Exception):
        assert_checks(run_checks({"t": df}, [Check("t", ("v",), "not_null")]))


def test_completed_rule(spark):
    from pitwall.plans.semantic import is_completed
    as_of = F.lit("2024-06-01").cast("timestamp_ntz")
    df = spark.createDataFrame([("N", T("2024-05-01 00:00:00")), (None, T("2024-05-01 00:00:00")), (None, None)],
                               "winner string, at timestamp_ntz")
    got = [r.s for r in df.select(is_completed(F.col("winner"), F.col("at"), as_of).alias("s")).collect()]
    assert got == ["COMPLETED", "CANCELLED", "UPCOMING"]


def test_forgotten_context_is_built_anew(spark):
    from conftest import SF_SMALL
    from pitwall.catalog import ctx, forget
    first = ctx(spark, SF_SMALL)
    assert ctx(spark, SF_SMALL) is first
    forget(spark, SF_SMALL)
    assert ctx(spark, SF_SMALL) is not first


def test_first_match_and_ordinals_deal_rows_once(spark):
    """One shuffle of the points by a range join that keeps the first match; one of the rows by an ordinal."""
    from pitwall.operators.timeseries import seq_index
    pts = spark.createDataFrame([(k, p, "x") for k in (1, 2, None) for p in (1, 5, 20, None)], "k int, p int, v string")
    iv = spark.createDataFrame([(1, 1, 9, 2), (1, 4, 6, 1), (2, 30, 40, 1)], "k int, lo int, hi int, n int")
    out = range_join(pts, iv, ["k"], "p", "lo", "hi", first_by=[F.col("n")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2         # one a side
    got = {(r.k, r.p): r.n for r in out.collect()}
    assert len(got) == 12 and {k: v for k, v in got.items() if v} == {(1, 1): 2, (1, 5): 1}

    rows_ = spark.createDataFrame([(k, x) for k in ("a", None) for x in (7, 70, 8, None, 71)], "k string, x long")
    out = seq_index(rows_, ["k"], [F.col("x").asc_nulls_first()], "i", 1, bucket=("x", 50), length="n")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(_part") == 2
    assert out.columns == ["k", "x", "n", "i"]
    assert {(r.k, r.x): (r.i, r.n) for r in out.collect()} == {
        (k, x): (i, 5) for k in ("a", None) for i, x in enumerate((None, 7, 8, 70, 71), 1)}
