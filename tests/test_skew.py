"""Hot keys: ordinals, as-of joins and interval lookups that no task holds a whole key of."""

import datetime as dt
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from pitwall.operators import asof_join, gap_fill_linear, locate, range_join, seq_index
from pitwall.operators.joins import asof_parts, overlap_free
from pitwall.streaming.asof import STATE_STORE, asof_stream


@pytest.fixture(scope="module")
def hot(spark):
    """20,000 samples, a third of them of one key inside one second, with repeats."""
    n = 20_000
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 3001).otherwise(F.col("id") * 1000).alias("at"),
        (F.col("id") * 7919 % n).alias("v"))


def test_one_series_of_all_rows(spark, hot):
    out = seq_index(hot.withColumn("s", F.lit(1)), ["s"], [F.col("at").desc(), F.col("v")], "i", 0, length="n")
    rows = sorted((r["i"], r["n"], -r["at"], r["v"]) for r in out.collect())
    assert [r[0] for r in rows] == list(range(20_000)) and {r[1] for r in rows} == {20_000}
    assert [r[2:] for r in rows] == sorted(r[2:] for r in rows)
    assert out.columns == ["k", "at", "v", "s", "n", "i"]


def test_series_with_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", None), ("a", 5)], "s string, t int")
    got = sorted((str(r["s"]), r["i"], str(r["t"])) for r in seq_index(df, ["s"], [F.col("t").asc_nulls_first()], "i").collect())
    assert got == [("None", 1, "1"), ("None", 2, "2"), ("a", 1, "None"), ("a", 2, "5")]
    assert seq_index(df.limit(0), ["s"], [F.col("t")], "i").count() == 0


def test_gap_fill_over_many_runs(spark):
    n = 10_000
    df = spark.range(n).select(F.lit("s").alias("s"), F.col("id").alias("t"),
                               F.when(F.col("id").isin(0, n - 1), F.col("id").cast("double")).alias("x"))
    got = gap_fill_linear(df, ["s"], [F.col("t")], ["x"])
    assert got.agg(F.count("*"), F.max(F.abs(F.col("x") - F.col("t")))).first()[:] == (n, pytest.approx(0, abs=1e-6))


def test_dense_key_is_spread_over_parts(spark, hot):
    left, right = hot.where("v % 2 = 0").select("k", "at"), hot.where("v % 2 = 1").select("k", F.col("at").alias("r"), "v")
    # parts of a few kB would be merged into one by their size in bytes
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = asof_parts(left, right, ["k"], "at", "r")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in parts.where("k = 'hot'").groupBy("_sb").count().collect()]
    shares = parts.select("_sb").distinct().count()
    assert len(sizes) > 1 and max(sizes) < 2 * parts.count() / shares
    # one bucket of an hour would hold them all
    assert parts.where("k = 'hot'").select(F.floor(F.col("_t") / 3600)).distinct().count() == 1


@pytest.mark.parametrize("width", [None, 500.0])
def test_asof_of_dense_key(spark, hot, width):
    left, right = hot.where("v % 2 = 0"), hot.where("v % 5 = 1").select("k", F.col("at").alias("r"), F.col("v").alias("w"))
    by_key = {}
    for r in right.collect():
        by_key.setdefault(r["k"], []).append((r["r"], r["w"]))
    want = sorted((r["k"], r["at"], r["v"], *max((m for m in by_key.get(r["k"], []) if m[0] <= r["at"]),
                                                 default=(None, None))) for r in left.collect())
    got = asof_join(left, right, ["k"], "at", "r", bucket_seconds=width).select("k", "at", "v", "r", "w").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def intervals_of(rng, touching):
    rows, at = [], 0
    for i in range(60):
        lo = at if touching and rng.random() < .6 else at + rng.randrange(1, 9)
        at = lo + rng.choice([0, 1, 5, 40])
        rows.append(("k", lo, at, i))
    return rows + [("k", None, 5, 90), ("k", 9, None, 91), ("z", 5, 1, 92)]


@pytest.mark.parametrize("seed", range(4))
def test_disjoint_lookup_equals_range_join(spark, seed):
    rng = random.Random(seed)
    iv = spark.createDataFrame(intervals_of(rng, seed % 2), "k string, lo int, hi int, n int")
    pts = spark.createDataFrame([("k", x, x) for x in range(-2, 900)] + [(None, 3, -1), ("z", 3, -2)], "k string, t int, id int")
    order = [F.col("lo").asc(), F.col("n").asc()]
    assert overlap_free(iv, ["k"], "lo", "hi", 1)
    one, two = (sorted(map(tuple, locate(pts, iv, ["k"], "t", "lo", "hi", order=order, disjoint=d).collect()))
                for d in (None, False))
    assert one == two and one


def test_overlaps_are_found(spark):
    for rows, free in (([(0, 5), (5, 9)], True), ([(0, 5), (4, 9)], False), ([(0, 9), (2, 3)], False),
                       ([(0, 5), (0, 5)], False), ([(3, 3), (3, 3)], True), ([(5, 1), (0, 9)], True)):
        iv = spark.createDataFrame([("k", *r) for r in rows], "k string, lo int, hi int")
        assert overlap_free(iv, ["k"], "lo", "hi", 1) is free


def test_disjoint_lookup_shuffles_points_for_one_join(spark):
    iv = spark.range(1000).select(F.lit("k").alias("k"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 5).alias("hi"))
    pts = spark.range(5000).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    plan = locate(pts, iv, ["k"], "t", "lo", "hi", order=[F.col("lo")])._jdf.queryExecution().optimizedPlan().toString()
    assert "_bkt" not in plan and "sequence(" not in plan
    assert "_bkt" in range_join(pts, iv, ["k"], "t", "lo", "hi")._jdf.queryExecution().optimizedPlan().toString()


def test_streamed_asof_in_any_order_within_the_watermark(spark):
    """Files out of order by less than the delay; state is settled and late rows are dropped."""
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), start + dt.timedelta(seconds=7 * i, microseconds=rng.randrange(10 ** 6)),
             rng.choice(["l", "r"]), i) for i in range(400)]
    want = {}
    for k, t, side, i in rows:
        if side == "l":
            want[i] = max(((u, j) for q, u, s, j in rows if q == k and s == "r" and u <= t), default=(None, None))[1]
    shuffled = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(300)))   # up to 5 minutes late
    src, out, ck = (tempfile.mkdtemp(prefix=p) for p in ("pw-as-", "pw-ao-", "pw-ac-"))
    batches = [shuffled[i:i + 80] for i in range(0, 400, 80)]
    batches += [[(None, start + dt.timedelta(days=9), "l", -1)], [("a", start, "l", -5)], [(None, start + dt.timedelta(days=19), "l", -1)]]
    schema = "k string, t timestamp_ntz, side string, i int"
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        for f in os.listdir(src):                       # files are read in the order of their times
            if f.endswith(".parquet") and not f.startswith("done"):
                os.rename(f"{src}/{f}", f"{src}/done{n}-{f}")
                os.utime(f"{src}/done{n}-{f}", (time.time() - 1000 + n, time.time() - 1000 + n))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(src)
    left = s.where("side = 'l'").select("k", "t", "i")
    right = s.where("side = 'r'").select("k", F.col("t").alias("rt"), F.col("i").alias("j"))
    old = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        asof_stream(left, right, ["k"], "t", "rt", "10 minutes").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], old) if old else spark.conf.unset(STATE_STORE[0])
    got = {r["i"]: r["j"] for r in spark.read.parquet(out).collect()}
    assert got == want                                  # the row that came days late (-5) is not among them


def test_stints_stay_in_few_lap_buckets(spark, monkeypatch):
    """A stint was a row, and a partial aggregate, for every lap that it covers."""
    from pitwall.operators import joins
    from pitwall.plans.marts import Marts
    stints = [(1, 1, k, 16 * k - 10, 16 * k + 5, "SOFT", 0) for k in range(1, 41)]
    laps = [(1, 1, n, 80.0 + n, False) for n in range(1, 700)]
    stg = {"stg_stints": spark.createDataFrame(stints, "session_key int, driver_number int, stint_number int, lap_start int, "
                                               "lap_end int, tyre_compound string, tyre_age_at_start int"),
           "stg_laps": spark.createDataFrame(laps, "session_key int, driver_number int, lap_number int, "
                                             "lap_duration_s double, is_pit_out_lap boolean"),
           "stg_drivers": spark.createDataFrame([(1, 1, "A", "B", "T")], "session_key int, driver_number int, "
                                                "full_name string, acronym string, team_name string")}
    exploded = []
    explode = joins._explode_buckets
    monkeypatch.setattr(joins, "_explode_buckets", lambda *a: exploded.append(explode(*a)) or exploded[-1])
    marts = Marts(stg)
    got = {r["stint_number"]: (r["clean_laps"], r["fastest_lap_s"]) for r in marts.fct_stints.collect()}
    assert got == {k: (sum(lo <= n <= hi and 80 + n < 120 for n in range(1, 700)),
                       80.0 + lo if 80 + lo < 120 else None) for _, _, k, lo, hi, _, _ in stints}
    tyre = {r["lap_number"]: r["tyre_compound"] for r in marts.fct_laps.collect()}
    assert tyre == {n: "SOFT" if 6 <= n <= 645 else None for n in range(1, 700)}
    assert [df.count() <= 2 * len(stints) for df in exploded] == [True, True]
