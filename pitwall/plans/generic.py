"""Operator checks on the driver tables: every generic operator of the
library run over whole tables (events, lineitem, orders, customer, …),
each with an independent SQL oracle."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall.functions import scalars as S
from pitwall.functions.variant import extract, raw_path
from pitwall.operators.dedupe import keep_first, latest_per_key
from pitwall.operators.joins import (adjacent_join, anti, asof_join, enrich, enrich_roles, locate,
                                     range_agg, range_join)
from pitwall.operators.timeseries import (argmax_per_point, gap_fill_linear, last_non_null, resample_linear,
                                          seq_index)
from pitwall.plans.marts import exact_avg, exact_slope
from pitwall.sources.landing import backfill_keys
from pitwall.sources.tables import Tables

EVENT_TYPES = ("signup", "purchase", "error", "view", "click")
STATUS_AS_OF = dt.datetime(1998, 1, 1)


def _v(df: DataFrame, *fields) -> DataFrame:
    """Pack columns into a VARIANT object column named raw_data."""
    return df.withColumn("raw_data", F.to_variant_object(F.struct(*fields)))


def variant_project(t: Tables) -> DataFrame:
    """JSON text → VARIANT → typed path."""
    e = t.events.select("event_id", F.parse_json("props").alias("raw_data"))
    return e.select("event_id", extract("k", "int").alias("k"))


def variant_null_filter(t: Tables) -> DataFrame:
    """P5: JSON null passes the path test, fails the typed test; a missing path fails both."""
    e = t.events.select("event_id", "value")
    jnull = _v(e.where("event_id % 3 = 0"), "event_id", F.lit(None).cast("double").alias("value"))
    missing = _v(e.where("event_id % 3 = 1"), "event_id")
    present = _v(e.where("event_id % 3 = 2"), "event_id", "value")
    raw = jnull.unionByName(missing).unionByName(present).select("event_id", "raw_data")
    return raw.select("event_id", raw_path("value").isNotNull().alias("has_path"),
                      extract("value", "double").isNotNull().alias("has_value"),
                      extract("value", "double").alias("v"))


def lenient_cast(t: Tables) -> DataFrame:
    """Lenient numeric cast of text (non-numeric → NULL)."""
    o = t.orders.select("o_orderkey", F.to_variant_object(F.struct(
        F.substring("o_orderpriority", 1, 1).alias("prefix"), F.col("o_orderpriority").alias("full"))).alias("raw_data"))
    return o.select("o_orderkey", extract("prefix", "try_double").alias("prio_num"),
                    extract("full", "try_double").alias("full_num"))


def strict_numeric(t: Tables) -> DataFrame:
    """Strict (numbers only) vs lenient numeric extraction over
    number / numeric text / array / JSON null / missing values."""
    e = t.events.select("event_id", "value")
    k = F.col("event_id") % 5
    payload = (F.when(k == 0, F.col("value").cast("variant"))
               .when(k == 1, F.col("value").cast("string").cast("variant"))
               .when(k == 2, F.to_variant_object(F.array("value"))))
    with_v = e.where(k != 4).select("event_id", F.to_variant_object(F.struct(payload.alias("x"))).alias("raw_data"))
    without = e.where(k == 4).select("event_id", F.to_variant_object(F.struct("event_id")).alias("raw_data"))
    raw = with_v.unionByName(without)
    return raw.select("event_id", extract("x", "as_double").alias("strict_v"),
                      extract("x", "try_double").alias("lenient_v"))


def flag_project(t: Tables) -> DataFrame:
    """Integer code → boolean flag (NULL stays NULL)."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag",
                           F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).alias("code"))
    li = _v(li, "code")
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", extract("code", "flag").alias("is_returned"))


def latest_events(t: Tables) -> DataFrame:
    """Newest event per (user, type)."""
    return latest_per_key(t.events, ["user_id", "event_type"], order=[F.col("ts").desc()])


def latest_lineitem(t: Tables) -> DataFrame:
    """W1 on a key that is really duplicated, with an explicit total-order tiebreak."""
    tb = [F.col(c).asc() for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                                   "l_tax", "l_returnflag", "l_linestatus")]
    return latest_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], order=[F.col("l_shipdate").desc()],
                          tiebreak=tb)


def star_enrich(t: Tables) -> DataFrame:
    """Fact ⟕ four dimensions on single keys."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = enrich(li, t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"],
                 ["o_orderdate", "o_custkey"])
    out = enrich(out, t.customer.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"],
                 ["c_name", "c_nationkey"])
    out = enrich(out, t.nation.withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"],
                 ["n_name", "n_regionkey"])
    out = enrich(out, t.region.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"], ["r_name"])
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "o_orderdate", "c_name", "n_name", "r_name")


def role_enrich(t: Tables) -> DataFrame:
    """Nation as customer nation and as supplier nation."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    li = enrich(li, t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"], ["o_custkey"])
    li = enrich(li, t.customer.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"],
                {"cust_nationkey": "c_nationkey"})
    li = enrich(li, t.supplier.withColumnRenamed("s_suppkey", "l_suppkey"), ["l_suppkey"],
                {"supp_nationkey": "s_nationkey"})
    out = enrich_roles(li, t.nation, "n_nationkey", {"cust_nationkey": {"cust_nation": "n_name"},
                                                     "supp_nationkey": {"supp_nation": "n_name"}})
    return out.select("l_orderkey", "l_linenumber", "cust_nation", "supp_nation")


def _events_ord(t: Tables) -> DataFrame:
    """Per-user ordinal in time order (bucketed by day: no user sorted in one task)."""
    return seq_index(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "ord", 1, bucket=("ts", 86400.0))


def _blocks(t: Tables) -> DataFrame:
    """Blocks of 5 ordinals per user; every 4th block overlaps the next by
    2, every 7th (by user + block) is missing."""
    b = (_events_ord(t).withColumn("block", F.expr("(ord - 1) div 5 + 1"))
         .groupBy("user_id", "block").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")))
    return b.where("(user_id + block) % 7 <> 0").select(
        "user_id", "block", "lo", F.expr("CASE WHEN block % 4 = 0 THEN hi + 2 ELSE hi END").alias("hi"))


def range_join_first(t: Tables) -> DataFrame:
    """Each event's first containing block (or none)."""
    ev = _events_ord(t).select("event_id", "user_id", "ord")
    return range_join(ev, _blocks(t), ["user_id"], "ord", "lo", "hi", how="left",
                      first_by=[F.col("block").asc_nulls_last()], point_key=["event_id"]) \
        .select("event_id", "user_id", "ord", "block")


def block_stats(t: Tables) -> DataFrame:
    """J6 + A1-A5: per block count / min / avg / spread / end-point slope /
    regression slope over the "clean" events (value < 400); empty blocks kept."""
    pts = _events_ord(t).where(F.col("value") < 400).select("user_id", "ord", "value")
    v, o, lo, hi = F.col("value"), F.col("ord"), F.col("lo"), F.col("hi")
    aggs = [F.count(o).alias("n"), F.min(v).alias("min_v"), exact_avg(v).alias("avg_v"),
            (exact_avg(v) - F.min(v)).alias("gap_v"),
            F.round((F.max(F.when(o == hi, v)) - F.min(F.when(o == lo, v))) / F.nullif(hi - lo, F.lit(0)), 3)
            .alias("deg_end"),
            F.round(exact_slope(v, o), 3).alias("deg_slope")]
    return range_agg(_blocks(t), pts, ["user_id"], "ord", "lo", "hi", aggs)


def adjacent_blocks(t: Tables) -> DataFrame:
    """For every event, the block ending at its ordinal and the one starting after it."""
    ev = _events_ord(t).select("event_id", "user_id", "ord")
    return adjacent_join(ev, _blocks(t), ["user_id"], "ord", "lo", "hi", before={"block_out": "block"},
                         after={"block_in": "block"})


def asof_view_purchase(t: Tables) -> DataFrame:
    """Each purchase with the user's latest view at or before it."""
    p = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = t.events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"),
                                                     F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    return asof_join(p, v, ["user_id"], "ts", "view_ts")


def point_in_interval(t: Tables) -> DataFrame:
    """Each error inside the closed span between consecutive signups of
    its user (the earlier span wins on a shared boundary); others dropped.
    Spans between neighbours share end points at most, by construction."""
    su = seq_index(t.events.where("event_type = 'signup'"), ["user_id"], [F.col("ts"), F.col("event_id")], "i", 0,
                   bucket=("ts", 86400.0))
    nxt = su.select("user_id", (F.col("i") - 1).alias("i"), F.col("ts").alias("hi"))
    s = su.join(nxt, ["user_id", "i"], "left").select(
        "user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("lo"), "hi")
    e = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return locate(e, s, ["user_id"], "ts", "lo", "hi", order=[F.col("lo").asc(), F.col("signup_id").asc()],
                  point_key=["event_id"], width=86400.0, disjoint=True).select("event_id", "user_id", "ts", "signup_id")


def anti_guard(t: Tables) -> DataFrame:
    """Customers without any urgent order (keys not yet "landed")."""
    return anti(t.customer.select("c_custkey", "c_name"),
                t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey")),
                ["c_custkey"])


RARE_TYPES = ("signup", "error")


def backfill_worklist(t: Tables) -> DataFrame:
    """Customers never seen in events (new) ∪ users without a signup or
    an error, also those whose events are all of other types."""
    src = t.customer.select(F.col("c_custkey").alias("key"))
    loaded = t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("part"))
    return backfill_keys(src, loaded, "key", "part", RARE_TYPES)


def range_join_long(t: Tables) -> DataFrame:
    """Line items against order spans of up to 30 million units, the first span per line."""
    spans = t.orders.select("o_custkey", F.col("o_orderkey").alias("span_order"),
                            (F.col("o_orderkey") * 1000).alias("lo"),
                            (F.col("o_orderkey") * 1000 + F.col("o_orderkey") % 7 * 5_000_000).alias("hi"))
    lines = t.lineitem.join(t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"]).select(
        "o_custkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("p"))
    return range_join(lines, spans, ["o_custkey"], "p", "lo", "hi", how="left", first_by=[F.col("span_order")],
                      point_key=["l_orderkey", "l_linenumber"], rows=t.lineitem.count()) \
        .select("l_orderkey", "l_linenumber", "span_order")


def _event_lines(t: Tables, where: str = "true") -> DataFrame:
    """Landing lines of the events that ``where`` selects: good objects, arrays, JSON-null keys, bad keys, junk (by event id)."""
    k = F.col("event_id") % 6
    u, d, i = (c.cast("string") for c in (F.col("user_id"), F.col("event_id") % 20, F.col("event_id")))
    rec = F.concat(F.lit('{"session_key": '), u, F.lit(', "driver_number": '), d, F.lit(', "id": '), i, F.lit("}"))
    line = (F.when(k == 0, F.lit("oops")).when(k == 1, F.lit('{"session_key": "abc"}')).when(k == 2, F.lit("[1, 2]"))
            .when(k == 3, F.concat(F.lit("["), rec, F.lit(', {"session_key": "x"}]')))
            .when(k == 4, F.concat(F.lit('{"session_key": null, "id": '), i, F.lit("}"))).otherwise(rec))
    return t.events.where(where).select(line.alias("value"))


def landing_report(t: Tables) -> DataFrame:
    """Load report over all event lines: rejected lines do not stop the others,
    sessions divisible by 4 are landed already, customers are the work list."""
    from pitwall.sources.landing import lenient_key, load_report, parse_records
    accepted, rejected = parse_records(_event_lines(t), "laps")
    old = F.coalesce(lenient_key() % 4 == 0, F.lit(False))
    work = t.customer.select(F.lit("laps").alias("endpoint"), F.col("c_custkey").alias("session_key"))
    return load_report(accepted.where(~old), rejected, accepted.where(old), work)


def landing_work_list(t: Tables) -> DataFrame:
    """Records of a work list of sessions and drivers."""
    from pitwall.sources.landing import for_work, parse_records
    accepted, _ = parse_records(_event_lines(t), "car_data")
    work = t.customer.select(F.col("c_custkey").alias("session_key"),
                             (F.col("c_custkey") % 20).alias("driver_number"))
    return for_work(accepted, work).select(extract("id", "long").alias("event_id"))


def landing_guard(t: Tables) -> DataFrame:
    """Orders of customers of whom nothing is landed; orders without a customer key are one key.
    Every third order was landed before, with its key in the load manifest."""
    import uuid

    from pitwall.session import checkpoint_dir
    from pitwall.sources.landing import LoadManifest, parse_records
    key = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey").cast("string")).otherwise(F.lit("null"))
    lines = t.orders.select(F.concat(F.lit('{"session_key": '), key, F.lit(', "id": '),
                                     F.col("o_orderkey").cast("string"), F.lit("}")).alias("value"))
    records, _ = parse_records(lines, "laps")
    base = f"{checkpoint_dir(t.spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
    manifest = LoadManifest(t.spark, f"{base}/raw", f"{base}/manifest")
    manifest.load(records.where(extract("id", "long") % 3 == 0))
    return manifest.new_records(records.where(extract("id", "long") % 3 != 0)) \
        .select(extract("id", "long").alias("o_orderkey"))


def streamed_landing(t: Tables) -> DataFrame:
    """ST1: all event lines written as files and landed by the stream; rows per session."""
    import uuid

    from pitwall.session import checkpoint_dir
    from pitwall.sources.landing import read_raw
    from pitwall.streaming.ingest import incremental_land
    base = f"{checkpoint_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    _event_lines(t).write.text(f"{base}/src/laps")
    for _ in range(2):      # the second run finds nothing new
        incremental_land(t.spark, f"{base}/src", "laps", f"{base}/raw", f"{base}/checkpoint").awaitTermination()
    return read_raw(t.spark, f"{base}/raw", "laps").groupBy(extract("session_key", "int").alias("session_key")).agg(
        F.count(F.lit(1)).alias("n"))


def streamed_latest(t: Tables) -> DataFrame:
    """ST2: landed event records staged by the stream to the latest per (session, driver)."""
    import uuid

    from pitwall.plans.staging import MODELS
    from pitwall.session import checkpoint_dir
    from pitwall.sources.landing import parse_records, write_raw
    from pitwall.streaming.ingest import stage_stream
    base = f"{checkpoint_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rec = F.to_json(F.struct(F.col("user_id").alias("session_key"), (F.col("event_id") % 20).alias("driver_number"),
                             (F.col("event_id") % 50).cast("int").alias("position")))
    lines = t.events.select(rec.alias("value"), (F.lit("2024-01-01").cast("timestamp")
                                                 + F.make_dt_interval(secs=F.col("event_id"))).alias("at"))
    accepted, _ = parse_records(lines, "starting_grid", loaded_at_col="at")
    write_raw(accepted, f"{base}/raw")
    stage_stream(t.spark, f"{base}/raw", "starting_grid", MODELS["stg_starting_grid"], f"{base}/staged",
                 f"{base}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{base}/staged").select("session_key", "driver_number", "grid_position")


def _stream_base(t: Tables) -> str:
    import uuid

    from pitwall.session import checkpoint_dir
    return f"{checkpoint_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _run_stream(stream: DataFrame, base: str, conf: tuple[str, str] | None = None) -> DataFrame:
    """All available input through the stream into a table, which is read back."""
    spark = stream.sparkSession
    old = spark.conf.get(conf[0], None) if conf else None
    if conf:
        spark.conf.set(*conf)
    try:
        stream.writeStream.format("parquet").option("path", f"{base}/out").option(
            "checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start() \
            .awaitTermination()
    finally:
        if conf:
            spark.conf.set(conf[0], old) if old else spark.conf.unset(conf[0])
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def streamed_asof(t: Tables) -> DataFrame:
    """J8 as a stream: purchases with the user's latest view, from files of events in no order;
    a last file with a far instant settles what waits."""
    from pitwall.streaming.asof import STATE_STORE, asof_stream
    base = _stream_base(t)
    ev = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    ev.repartition(4, "event_id").write.parquet(f"{base}/src")
    far = t.spark.range(1).selectExpr("CAST(NULL AS BIGINT) AS event_id", "CAST(NULL AS BIGINT) AS user_id",
                                      "TIMESTAMP_NTZ'2200-01-01 00:00:00' AS ts", "'purchase' AS event_type",
                                      "CAST(NULL AS DOUBLE) AS value")
    far.select(*[F.col(f.name).cast(f.dataType) for f in ev.schema.fields]).write.mode("append").parquet(f"{base}/src")
    s = t.spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 3).parquet(f"{base}/src")
    p = s.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = s.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"),
                                              F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    return _run_stream(asof_stream(p, v, ["user_id"], "ts", "view_ts", "36500 days"), base, STATE_STORE)


def streamed_first_wins(t: Tables) -> DataFrame:
    """ST3: every third event is sent twice; the stream keeps one of each."""
    from pitwall.streaming.ingest import first_wins
    base = _stream_base(t)
    ev = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    ev.unionByName(ev.where("event_id % 3 = 0")).repartition(4, "event_id").write.parquet(f"{base}/src")
    s = t.spark.readStream.schema(ev.schema).parquet(f"{base}/src")
    return _run_stream(first_wins(s, ["event_id"], "at", "36500 days").select("event_id", "user_id"), base)


def streamed_enrich(t: Tables) -> DataFrame:
    """ST4: a stream of orders with the customer's name; orders of every seventh customer find none."""
    from pitwall.streaming.ingest import enrich_stream
    base = _stream_base(t)
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    orders.write.parquet(f"{base}/src")
    s = t.spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/src")
    return _run_stream(enrich_stream(s, t.customer.where("c_custkey % 7 <> 0"), ["c_custkey"], ["c_name"]), base)


def landing_subset(t: Tables) -> DataFrame:
    """A chosen subset of endpoints landed as one job from files of event records, the session endpoints
    for a work list of customers; an endpoint without a folder lands nothing."""
    from pitwall.sources.landing import land_all, lenient_key
    base = _stream_base(t)
    for i, endpoint in enumerate(("laps", "pit", "sessions", "weather")):
        _event_lines(t, f"event_id % 4 >= {i}").write.text(f"{base}/{endpoint}")
    work = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("session_key"))
    accepted, rejected = land_all(t.spark, base, ["laps", "pit", "sessions", "meetings"], work)
    count = lambda df, kind: df.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return count(accepted, "accepted").unionByName(count(rejected, "rejected")).unionByName(
        count(accepted.where(lenient_key().isNull()), "without key"))


def series_ordinals(t: Tables) -> DataFrame:
    """All events as one series, numbered without a bucket width; and its length."""
    one = t.events.select(F.lit(1).alias("series"), "event_id", "ts")
    return seq_index(one, ["series"], [F.col("ts"), F.col("event_id")], "nth", length="n").select("event_id", "nth", "n")


def cond_counts(t: Tables) -> DataFrame:
    """Conditional counts and a conditional pick per user."""
    et = F.col("event_type")
    return t.events.groupBy("user_id").agg(
        *[F.count(F.when(et == x, 1)).alias(f"n_{x}") for x in EVENT_TYPES],
        F.count(F.lit(1)).alias("n_all"),
        F.max(F.when(et == "purchase", F.col("value"))).alias("max_purchase"))


def best_customer_per_nation(t: Tables) -> DataFrame:
    """Aggregate first (cheapest order per customer), then top-1 per nation."""
    per = t.orders.groupBy("o_custkey").agg(F.min("o_totalprice").alias("min_price")) \
        .join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), ["o_custkey"], "inner")
    return keep_first(per, ["c_nationkey"], [F.col("min_price").asc(), F.col("o_custkey").asc()]) \
        .select("c_nationkey", F.col("o_custkey").alias("c_custkey"), "min_price")


def last_non_null_per_day(t: Tables) -> DataFrame:
    """Column-wise last non-null per (user, day) in time order."""
    e = t.events.select("user_id", F.to_date("ts").alias("day"), "ts",
                        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"),
                        F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("event_type"))
    return last_non_null(e, ["user_id", "day"], F.col("ts"), ["value", "event_type"])


def fastest_row(t: Tables) -> DataFrame:
    """Arg-min row per user (ties → lower event id)."""
    return t.events.groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("event_id"))


def resampled_values(t: Tables, n: int = 50) -> DataFrame:
    """Every user's value series resampled to n points."""
    return resample_linear(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "value", n,
                           bucket=("ts", 86400.0))


def point_winner(t: Tables, n: int = 50) -> DataFrame:
    """Per (group, point) the user with the largest resampled value (lowest user id on ties)."""
    r = resampled_values(t, n).withColumn("grp", F.col("user_id") % 10)
    return argmax_per_point(r, ["grp", "point"], "value", [F.col("user_id").asc()]) \
        .select("grp", "point", "user_id", "value")


def gap_filled(t: Tables) -> DataFrame:
    """Linear gap fill of a nullified series per user (leading gaps dropped)."""
    e = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"))
    return gap_fill_linear(e, ["user_id"], [F.col("ts"), F.col("event_id")], ["v"], bucket=("ts", 86400.0)) \
        .select("event_id", "user_id", "v")


def rotated(t: Tables) -> DataFrame:
    """rotate (value, event_id % 100) by -30 degrees."""
    x, y = S.rotate2d(F.col("value"), (F.col("event_id") % 100).cast("double"), 30.0)
    return t.events.select("event_id", F.round(x, 6).alias("rx"), F.round(y, 6).alias("ry"))


def classify_orders(t: Tables) -> DataFrame:
    """Result classification and gated places gained on synthetic flags."""
    o = t.orders.select(
        "o_orderkey",
        (F.col("o_orderkey") % 97 == 0).alias("is_dsq"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0)).alias("is_dns"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0)).alias("is_dnf"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 20 + 1).alias("finish"),
        (F.col("o_orderkey") % 3).alias("laps"), (F.col("o_custkey") % 20 + 1).alias("grid"),
        F.when(F.col("o_orderkey") % 2 == 0, "Race").otherwise("Qualifying").alias("stype"))
    return o.select("o_orderkey", S.classify_result("is_dsq", "is_dns", "is_dnf", "finish", "laps").alias("status"),
                    S.positions_gained("finish", "grid", "stype").alias("gained"))


def order_status(t: Tables) -> DataFrame:
    """COMPLETED / CANCELLED / UPCOMING against a fixed as-of, with date label."""
    o = t.orders.select("o_orderkey",
                        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")).alias("winner"),
                        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("start"))
    as_of = F.lit(STATUS_AS_OF.isoformat(sep=" ")).cast("timestamp_ntz")
    return o.select("o_orderkey", S.race_status("winner", "start", as_of).alias("status"),
                    S.format_date("start").alias("date_label"))


def lap_end(t: Tables) -> DataFrame:
    """timestamp + fractional seconds, exact and whole-second."""
    return t.events.select("event_id", S.add_seconds("ts", "value").alias("end_exact"),
                           S.add_seconds("ts", "value", whole_seconds=True).alias("end_whole"))


def normalise_filter(t: Tables) -> DataFrame:
    """Normalised flag, membership with blank pass-through, n of total per user."""
    k = F.col("event_id") % 4
    flag = (F.when(k == 0, F.upper("event_type")).when(k == 1, F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
            .when(k == 3, F.col("event_type")))
    cat = F.when(F.col("value") > 100, "High").otherwise("Low")
    e = t.events.select("user_id", S.normalise(flag).alias("flag"), cat.alias("category"))
    shown = F.col("category").isin("High") & (F.col("flag").isin("VIEW", "CLICK") | (F.col("flag") == ""))
    return e.groupBy("user_id").agg(F.count_if(shown).alias("n_shown"), F.count(F.lit(1)).alias("n_total"))


def _prio(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice",
                           F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("prio"))


def topk_nulls_last(t: Tables) -> DataFrame:
    """Top 10 by a nullable key, NULLS LAST, deterministic tiebreak."""
    return _prio(t).orderBy(F.col("prio").asc_nulls_last(), F.col("o_totalprice").desc(), "o_orderkey").limit(10)


def topk_desc_nulls_first(t: Tables) -> DataFrame:
    """O3: DESC with the warehouse's default NULLS FIRST, spelled out."""
    return _prio(t).orderBy(F.col("prio").desc_nulls_first(), "o_orderkey").limit(10)


def scalar_latest(t: Tables) -> DataFrame:
    """Rows of the latest key (uncorrelated scalar subquery)."""
    li = t.lineitem
    return li.where(F.col("l_orderkey") == li.select(F.max("l_orderkey")).scalar()) \
        .select("l_orderkey", "l_linenumber", "l_quantity")


def formatted_times(t: Tables) -> DataFrame:
    """m:ss.mmm lap text and signed deltas."""
    return t.events.select("event_id", S.format_laptime(F.col("value") * 3).alias("lap_text"),
                           S.format_delta(F.col("value") - 100).alias("delta_text"))


def landing_laps_roundtrip(t: Tables) -> DataFrame:
    """S1/F1 on the whole laps feed: records as JSON text lines → landing
    parser → staging. Must equal ``stg_laps``."""
    from pitwall.plans.staging import MODELS, stage
    from feeds import race
    from pitwall.sources.landing import parse_records
    lines = race.laps(t).select(F.to_json("raw_data").alias("value"), "loaded_at")
    accepted, _ = parse_records(lines, "laps", loaded_at_col="loaded_at")
    return stage(accepted.select("raw_data", "loaded_at"), MODELS["stg_laps"])


GENERIC: dict[str, Callable[[Tables], DataFrame]] = {
    "variant_project": variant_project,
    "variant_null_filter": variant_null_filter,
    "lenient_cast": lenient_cast,
    "strict_numeric": strict_numeric,
    "flag_project": flag_project,
    "latest_per_key_events": latest_events,
    "latest_per_key_lineitem": latest_lineitem,
    "star_enrich": star_enrich,
    "role_enrich": role_enrich,
    "range_join_first": range_join_first,
    "block_stats": block_stats,
    "adjacent_join": adjacent_blocks,
    "asof_view_purchase": asof_view_purchase,
    "point_in_interval": point_in_interval,
    "anti_guard": anti_guard,
    "backfill_keys": backfill_worklist,
    "cond_counts": cond_counts,
    "best_over_aggregate": best_customer_per_nation,
    "last_non_null": last_non_null_per_day,
    "fastest_row": fastest_row,
    "resample_linear": resampled_values,
    "point_winner": point_winner,
    "gap_fill": gap_filled,
    "rotate2d": rotated,
    "classify_case": classify_orders,
    "status_case": order_status,
    "lap_end": lap_end,
    "normalise_filter": normalise_filter,
    "topk_nulls_last": topk_nulls_last,
    "topk_desc_nulls_first": topk_desc_nulls_first,
    "scalar_latest": scalar_latest,
    "fmt_laptime": formatted_times,
    "landing_laps_roundtrip": landing_laps_roundtrip,
    "range_join_long": range_join_long,
    "landing_report": landing_report,
    "landing_work_list": landing_work_list,
    "landing_guard": landing_guard,
    "streamed_landing": streamed_landing,
    "streamed_latest": streamed_latest,
    "streamed_asof": streamed_asof,
    "streamed_first_wins": streamed_first_wins,
    "streamed_enrich": streamed_enrich,
    "landing_subset": landing_subset,
    "series_ordinals": series_ordinals,
}


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from pitwall.catalog import ctx

    def bind(fn):
        # the context's table accessor memoises (and materialises) shared derived tables
        return lambda spark, sf_dir: fn(ctx(spark, sf_dir).tables)
    return {name: bind(fn) for name, fn in GENERIC.items()}
