"""Landing from JSON files, load guards, and the streaming jobs."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from pitwall.plans.staging import MODELS
from pitwall.sources.landing import (backfill_keys, land, land_all, land_new, load_report, parse_records, read_raw,
                                     write_raw)
from pitwall.streaming.ingest import enrich_stream, first_wins, incremental_land, stage_stream, upsert_latest


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def _lap(s, d, n, dur):
    return {"session_key": s, "driver_number": d, "lap_number": n, "lap_duration": dur, "date_start": "2024-03-01T12:00:00+00:00"}


def test_land_arrays_objects_and_junk(spark):
    src = tempfile.mkdtemp(prefix="pitwall-src-")
    _write(f"{src}/laps/a.json", [json.dumps(_lap(1, 1, 1, 90.0)), json.dumps([_lap(1, 1, 2, 91.0), _lap(1, 1, 3, 92.0)]),
                                  "not json", "[1, 2]", "42"])
    acc, rej = land(spark, src, "laps")
    assert acc.count() == 3 and rej.count() == 3
    empty, _ = land(spark, src, "no_such_endpoint")
    assert empty.count() == 0
    raw = tempfile.mkdtemp(prefix="pitwall-raw-")
    write_raw(acc, raw)
    assert read_raw(spark, raw, "laps").count() == 3
    rep = {r.status: r for r in load_report(acc, rej).collect()}
    assert "error" in rep


def test_guards_and_backfill(spark):
    landed = spark.sql("SELECT parse_json('{\"session_key\": 1}') AS raw_data")
    new = spark.sql("SELECT parse_json(j) AS raw_data FROM VALUES ('{\"session_key\": 1}'), ('{\"session_key\": 2}') t(j)")
    assert land_new(new, landed, ["session_key"]).count() == 1
    src = spark.createDataFrame([(1,), (2,), (3,)], "key int")
    loaded = spark.createDataFrame([(1, "laps"), (1, "pit"), (2, "laps")], "key int, part string")
    wl = {(r.key, r.reason, r.missing) for r in backfill_keys(src, loaded, "key", "part", ["laps", "pit"]).collect()}
    assert wl == {(3, "new", None), (2, "incomplete", "pit")}


def test_incremental_land_exactly_once_and_upsert(spark):
    src, raw, ck, stg = (tempfile.mkdtemp(prefix=p) for p in ("pw-src-", "pw-raw-", "pw-ck-", "pw-stg-"))
    _write(f"{src}/laps/1.json", [json.dumps(_lap(9, 1, n, 90.0 + n)) for n in range(1, 4)])
    incremental_land(spark, src, "laps", raw, ck).awaitTermination()
    incremental_land(spark, src, "laps", raw, ck).awaitTermination()          # rerun: nothing new
    assert read_raw(spark, raw, "laps").count() == 3
    _write(f"{src}/laps/2.json", [json.dumps(_lap(9, 1, 2, 80.0)), json.dumps(_lap(9, 1, 3, None))])
    incremental_land(spark, src, "laps", raw, ck).awaitTermination()
    assert read_raw(spark, raw, "laps").count() == 5
    model = MODELS["stg_laps"]
    batches = spark.read.parquet(raw).where("endpoint = 'laps'")
    upsert_latest(spark, batches.where("_batch = 0").select("raw_data", "loaded_at"), model, stg)
    upsert_latest(spark, batches.where("_batch > 0").select("raw_data", "loaded_at"), model, stg)
    got = {r.lap_number: r.lap_duration_s for r in spark.read.parquet(stg).collect()}
    assert got == {1: 91.0, 2: 80.0, 3: 93.0}                               # JSON-null re-send does not shadow


def test_landing_keeps_what_other_runs_landed(spark):
    """A second source, or the same one after its checkpoint is lost, never replaces landed records."""
    a, b, raw = (tempfile.mkdtemp(prefix=p) for p in ("pw-a-", "pw-b-", "pw-raw-"))
    _write(f"{a}/laps/1.json", [json.dumps(_lap(1, 1, 1, 90.0))])
    _write(f"{b}/laps/1.json", [json.dumps(_lap(2, 1, 1, 91.0))])
    for src in (a, b, a):
        incremental_land(spark, src, "laps", raw, tempfile.mkdtemp(prefix="pw-ck-")).awaitTermination()
    assert {r.session_key for r in spark.read.parquet(raw).select("session_key").collect()} == {1, 2}


def test_bad_keys_are_rejected_not_raised(spark):
    src, raw = (tempfile.mkdtemp(prefix=p) for p in ("pw-bk-", "pw-bkr-"))
    _write(f"{src}/laps/1.json", [json.dumps(_lap(1, 1, 1, 90.0)), '{"session_key": "abc"}', '{"session_key": 1e30}',
                                  '{"session_key": null}'])
    acc, rej = land(spark, src, "laps")
    write_raw(acc, raw)
    assert read_raw(spark, raw, "laps").count() == 2 and rej.count() == 2


def test_guard_is_null_safe_and_per_endpoint(spark):
    q = "SELECT parse_json(j) AS raw_data, e AS endpoint FROM VALUES {} t(j, e)"
    landed = spark.sql(q.format("""('{"session_key": 1}', 'laps'), ('{"session_key": null}', 'laps')"""))
    new = spark.sql(q.format("""('{"session_key": 1}', 'laps'), ('{"session_key": 1}', 'pit'),
                                ('{"session_key": null}', 'laps')"""))
    assert [r.endpoint for r in land_new(new, landed, ["session_key"]).collect()] == ["pit"]


def test_backfill_reports_keys_without_any_expected_part(spark):
    src = spark.createDataFrame([(1,), (2,)], "key int")
    loaded = spark.createDataFrame([(1, "laps"), (1, "pit"), (2, "other")], "key int, part string")
    got = {(r.key, r.missing) for r in backfill_keys(src, loaded, "key", "part", ["laps", "pit"]).collect()}
    assert got == {(2, "laps"), (2, "pit")}


def test_every_model_streams(spark):
    sessions = spark.createDataFrame([(7, 2024)], "session_key int, year int")
    for name, model in MODELS.items():
        raw, ck, stg = (tempfile.mkdtemp(prefix=p) for p in ("pw-m-", "pw-mc-", "pw-ms-"))
        rec = {"session_key": 7, "meeting_key": 70, "driver_number": 1, "team_name": "T", "compound": "SOFT",
               "lap_duration": 90.0, "lap_number": 1, "stint_number": 1, "date": "2024-03-01T12:00:00+00:00",
               "message": "m", "overtaking_driver_number": 1, "overtaken_driver_number": 2}
        lines = spark.createDataFrame([(json.dumps(rec),)], "value string")
        acc, _ = parse_records(lines, model.endpoint)
        write_raw(acc, raw)
        stage_stream(spark, raw, model.endpoint, model, stg, ck, sessions=lambda: sessions).awaitTermination()
        assert spark.read.parquet(stg).count() == 1, name


def test_no_local_scratch_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from pitwall.session import checkpoint_dir
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None,
                         getConf=lambda: SimpleNamespace(get=lambda k: None))
    with pytest.raises(RuntimeError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc))


def test_first_wins_stream(spark):
    src = tempfile.mkdtemp(prefix="pw-fw-")
    spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:00:01", "b")],
                          "k int, t string, v string").withColumn("t", F.to_timestamp("t")).write.parquet(src + "/d")
    s = spark.readStream.schema("k int, t timestamp, v string").parquet(src + "/d")
    q = (first_wins(s, ["k"], "t", "1 minute").writeStream.format("memory").queryName("fw_out")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.sql("SELECT * FROM fw_out").count() == 2


def test_land_all_and_stream_stages(spark):
    src, raw, ck, stg = (tempfile.mkdtemp(prefix=p) for p in ("pw-la-", "pw-lr-", "pw-lc-", "pw-ls-"))
    _write(f"{src}/laps/1.json", [json.dumps(_lap(5, 2, n, 90.0 + n)) for n in range(1, 3)])
    _write(f"{src}/pit/1.json", [json.dumps({"session_key": 5, "driver_number": 2, "lap_number": 1,
                                             "pit_duration": 21.5, "date": "2024-03-01T12:10:00+00:00"})])
    acc, rej = land_all(spark, src, ["laps", "pit", "weather"])
    assert acc.count() == 3 and rej.count() == 0
    write_raw(acc, raw)
    stage_stream(spark, raw, "laps", MODELS["stg_laps"], stg, ck).awaitTermination()
    assert spark.read.parquet(stg).count() == 2


def test_enrich_stream(spark):
    d = tempfile.mkdtemp(prefix="pw-es-")
    spark.createDataFrame([(1, 7), (2, 8)], "session_key int, v int").write.parquet(d + "/s")
    dim = spark.createDataFrame([(1, "Race")], "session_key int, session_name string")
    s = spark.readStream.schema("session_key int, v int").parquet(d + "/s")
    q = (enrich_stream(s, dim, ["session_key"], ["session_name"]).writeStream.format("memory")
         .queryName("es_out").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.session_key: r.session_name for r in spark.sql("SELECT * FROM es_out").collect()}
    assert got == {1: "Race", 2: None}


def test_each_line_is_parsed_once(spark):
    """accepted records come from one scan of the lines that parses each of them once."""
    src = tempfile.mkdtemp(prefix="pw-po-")
    _write(f"{src}/laps/1.json", [json.dumps(_lap(1, 1, 1, 90.0)), "  " + json.dumps([_lap(1, 1, 2, 91.0), 3]), "{}",
                                  "[]", "{bad", "null", json.dumps([_lap("x", 1, 1, 1.0), _lap(2, 1, 1, 1.0)])])
    acc, rej = land(spark, src, "laps")
    plan = acc._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and "Union" not in plan
    assert sorted(json.loads(r[0]).get("lap_number", 0) for r in acc.selectExpr("to_json(raw_data)").collect()) == [0, 1, 1, 2]
    assert sorted(r.line[:5] for r in rej.collect()) == ['  [{"', '[{"se', "null", "{bad"]


def test_streamed_table_has_few_folders_for_many_sessions(spark):
    """files of a streamed table do not grow with its sessions; merges keep rows of other and of null sessions."""
    raw, ck, stg = (tempfile.mkdtemp(prefix=p) for p in ("pw-f-", "pw-fc-", "pw-fs-"))
    model = MODELS["stg_starting_grid"]

    def send(at, rows):
        lines = spark.createDataFrame([(json.dumps({"session_key": s, "driver_number": 1, "position": p}),)
                                       for s, p in rows], "value string").withColumn("at", F.lit(at).cast("timestamp"))
        write_raw(parse_records(lines, model.endpoint, loaded_at_col="at")[0], raw)
        stage_stream(spark, raw, model.endpoint, model, stg, ck).awaitTermination()
    send("2024-01-01", [(s, 1) for s in range(300)] + [(None, 1)])
    send("2024-01-02", [(5, 2), (400, 2)])
    send("2024-01-01", [(5, 3), (None, 4)])
    assert len([d for d in os.listdir(stg) if "=" in d]) <= 64
    got = {r.session_key: r.grid_position for r in spark.read.parquet(stg).collect()}
    assert len(got) == 302 and got[5] == 2 and got[400] == 2 and got[7] == 1 and None in got
