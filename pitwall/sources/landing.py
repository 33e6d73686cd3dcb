"""RAW landing (S1-S11) and key-set operations.

Files are the connector boundary: each endpoint directory holds JSON
records (one object per line, or one array of objects per line). Landing is
one distributed append of ``(raw_data VARIANT, loaded_at, endpoint,
session_key)`` partitioned by endpoint, instead of one INSERT per record.
Load guards are anti-joins against the keys already landed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType, VariantType

from pitwall.functions.variant import RAW, raw_path
from pitwall.session import materialize

RAW_SCHEMA = StructType([StructField(RAW, VariantType()), StructField("loaded_at", TimestampType()),
                         StructField("endpoint", StringType())])

# Endpoints loaded per session (and per driver for the two telemetry feeds)
# versus as whole tables.
SESSION_ENDPOINTS = ("drivers", "intervals", "laps", "overtakes", "pit", "position", "race_control",
                     "session_result", "stints", "team_radio", "weather", "car_data", "location")
BULK_ENDPOINTS = ("sessions", "meetings", "championship_drivers", "championship_teams", "starting_grid")


def lenient_key(path: str = "session_key", raw: str = RAW):
    """Typed key of a record: NULL for a JSON null, a missing path, text that is no number or one too large."""
    return F.round(F.try_variant_get(F.col(raw), f"$.{path}", "double")).try_cast("int")


def bad_key(path: str = "session_key", raw: str = RAW):
    """True where a record names a key that has no typed value (a JSON null names none)."""
    text = F.try_variant_get(F.col(raw), f"$.{path}", "string")
    return raw_path(path, raw).isNotNull() & text.isNotNull() & lenient_key(path, raw).isNull()


def parse_records(lines: DataFrame, endpoint: str, text_col: str = "value",
                  loaded_at_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Text lines → (accepted RAW rows, rejected lines). A line holding a
    JSON array contributes one row per element; unparsable lines and
    non-object payloads (an API error body, say) are rejected, not raised, as
    are lines with a record whose session key is not a number; the other
    records of such a line are accepted.
    ``loaded_at`` is the load time, or ``loaded_at_col`` when replaying
    records with their original load times."""
    # each text is parsed once: filters on an exploded column stay above the explode
    parsed = lines.select(F.col(text_col).alias("_text"),
                          (F.col(loaded_at_col) if loaded_at_col else F.current_timestamp()).alias("_la"),
                          F.explode(F.array(F.try_parse_json(F.col(text_col)))).alias("_v"))
    kind = F.schema_of_variant(F.col("_v"))
    # the first character tells an object from an array without writing out the record's type
    first = F.substring(F.ltrim(F.col("_text")), 1, 1)
    is_object = F.when(first == "{", F.lit(True)).when(first == "[", F.lit(False)).otherwise(kind.startswith("OBJECT"))
    is_array = F.when(first == "[", F.lit(True)).when(first == "{", F.lit(False)).otherwise(kind.startswith("ARRAY"))
    items = F.variant_get(F.col("_v"), "$", "array<variant>")
    # non-object elements are dropped, line rejected
    records = F.when(is_object, F.array("_v")).when(is_array, F.filter(
        items, lambda x: F.schema_of_variant(x).startswith("OBJECT")))
    objects = parsed.where(F.col("_v").isNotNull()).select("_la", F.explode(records).alias("_v"))
    accepted = objects.where(~bad_key(raw="_v")).select(F.col("_v").alias(RAW), F.col("_la").alias("loaded_at"),
                                                        F.lit(endpoint).alias("endpoint"))
    all_objects = F.forall(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    bad_item = F.exists(items, lambda x: F.schema_of_variant(x).startswith(
        "OBJECT") & F.try_variant_get(x, "$.session_key", "string").isNotNull() & F.round(F.try_variant_get(
            x, "$.session_key", "double")).try_cast("int").isNull())
    ok = (is_object & ~bad_key(raw="_v")) | (is_array & all_objects & ~bad_item)
    rejected = parsed.where(F.col("_v").isNull() | ~ok) \
        .select(F.lit(endpoint).alias("endpoint"), F.col("_text").alias("line"))
    return accepted, rejected


def land(spark: SparkSession, src_dir: str, endpoint: str) -> tuple[DataFrame, DataFrame]:
    """Read an endpoint directory; a missing directory is zero rows."""
    try:
        lines = spark.read.text(f"{src_dir.rstrip('/')}/{endpoint}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
            raise
        empty = spark.createDataFrame([], RAW_SCHEMA)
        return empty, spark.createDataFrame([], "endpoint string, line string")
    return parse_records(lines, endpoint)


def for_work(accepted: DataFrame, work: DataFrame) -> DataFrame:
    """The records of a work list of ``session_key`` (and ``driver_number``), by typed keys."""
    keys = [k for k in ("session_key", "driver_number") if k in work.columns]
    typed = accepted.select("*", *[lenient_key(k).alias(f"_w_{k}") for k in keys])
    wanted = work.select(*[F.col(k).cast("int").alias(f"_w_{k}") for k in keys])
    return typed.join(wanted, [f"_w_{k}" for k in keys], "left_semi").select(*accepted.columns)


def land_all(spark: SparkSession, src_dir: str, endpoints: Sequence[str] = SESSION_ENDPOINTS + BULK_ENDPOINTS,
             work: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Land a chosen subset of endpoints as one job (one union).

    ``work`` limits the session endpoints to its sessions (and drivers);
    whole-table endpoints are always landed whole.
    """
    acc, rej = zip(*[land(spark, src_dir, e) for e in endpoints])
    a, r = acc[0], rej[0]
    for x in acc[1:]:
        a = a.unionByName(x)
    for x in rej[1:]:
        r = r.unionByName(x)
    if work is not None:
        per_session = F.col("endpoint").isin(list(SESSION_ENDPOINTS))
        a = for_work(a.where(per_session), work).unionByName(a.where(~per_session))
    return a, r


def with_session_key(raw: DataFrame) -> DataFrame:
    """Typed partition key; NULL where the record has none."""
    return raw.withColumn("session_key", lenient_key())


def write_raw(accepted: DataFrame, raw_dir: str) -> None:
    """Append to the RAW table, partitioned by endpoint."""
    with_session_key(accepted).write.mode("append").partitionBy("endpoint").parquet(raw_dir)


# --------------------------------------------------------------------------- load manifest
class LoadManifest:
    """The keys landed so far, by endpoint, beside the RAW table.

    The guard of a load reads this small table of distinct keys instead of
    parsing a key out of every landed record. Each load writes its keys twice:
    as ``announced`` before its records are appended to RAW and as ``landed``
    after that. A load that is announced but not landed was cut short, so its
    keys are looked up in RAW once more (``recover``); a lost manifest is made
    again from RAW (``rebuild``).
    """

    def __init__(self, spark: SparkSession, raw_dir: str, manifest_dir: str, key_paths: Sequence[str] = ("session_key",)):
        self.spark, self.raw_dir, self.dir, self.key_paths = spark, raw_dir, manifest_dir.rstrip("/"), list(key_paths)
        self.schema = StructType([StructField("load", StringType()), StructField("endpoint", StringType()),
                                  *[StructField(k, StringType()) for k in self.key_paths],
                                  StructField("state", StringType())])

    def keys_of(self, records: DataFrame) -> DataFrame:
        """Distinct (endpoint, keys) of RAW records; a key that is absent or null is null."""
        return records.select("endpoint", *[F.try_variant_get(F.col(RAW), f"$.{p}", "string").alias(p)
                                            for p in self.key_paths]).distinct()

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.dir)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def _append(self, keys: DataFrame, load: str, state: str, mode: str = "append") -> None:
        keys.select(F.lit(load).alias("load"), "endpoint", *self.key_paths, F.lit(state).alias("state")) \
            .write.mode(mode).partitionBy("state").parquet(self.dir)

    def landed(self) -> DataFrame:
        """Distinct (endpoint, keys) landed so far."""
        return self._rows().where("state = 'landed'").select("endpoint", *self.key_paths).distinct()

    def cut_short(self) -> DataFrame:
        """(load, endpoint, keys) of loads that were announced but not recorded as landed."""
        rows = self._rows()
        done = rows.where("state = 'landed'").select("load").distinct()
        return rows.where("state = 'announced'").drop("state").join(done, ["load"], "left_anti")

    def recover(self) -> None:
        """Record what loads that were cut short had appended to RAW before."""
        open_keys = self.cut_short()
        loads = materialize(open_keys, "cut_short")
        if loads.isEmpty():
            return
        cond = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ["endpoint", *self.key_paths]])
        there = self.keys_of(self.spark.read.parquet(self.raw_dir)).alias("r").join(loads.alias("c"), cond, "left_semi")
        done = loads.alias("c").join(there.alias("r"), cond, "left_semi").select("c.load", "c.endpoint",
                                                                            *[f"c.{k}" for k in self.key_paths])
        # a load of which nothing arrived is closed by a row without an endpoint
        closed = loads.select("load").distinct().select("load", F.lit(None).cast("string").alias("endpoint"), *[
            F.lit(None).cast("string").alias(k) for k in self.key_paths])
        materialize(done.unionByName(closed), "recovered").withColumn("state", F.lit("landed")) \
            .write.mode("append").partitionBy("state").parquet(self.dir)

    def rebuild(self) -> None:
        """The manifest made again from RAW."""
        self._append(self.keys_of(self.spark.read.parquet(self.raw_dir)), "rebuilt", "landed", mode="overwrite")

    def new_records(self, records: DataFrame) -> DataFrame:
        """Records whose endpoint and keys are not landed yet; RAW is not read."""
        return land_new(records, self.landed(), self.key_paths)

    def load(self, records: DataFrame) -> None:
        """Append the new ones of ``records`` to RAW and their keys to the manifest."""
        self.recover()
        fresh = materialize(self.new_records(records), "fresh")
        if fresh.isEmpty():
            return
        load = uuid.uuid4().hex
        keys = materialize(self.keys_of(fresh), "keys")
        self._append(keys, load, "announced")
        write_raw(fresh, self.raw_dir)
        self._append(keys, load, "landed")


def read_raw(spark: SparkSession, raw_dir: str, endpoint: str) -> DataFrame:
    """One endpoint of the RAW table (partition pruned)."""
    return spark.read.parquet(raw_dir).where(F.col("endpoint") == endpoint).select(RAW, "loaded_at")


def land_new(new: DataFrame, landed: DataFrame, key_paths: Sequence[str]) -> DataFrame:
    """Keep incoming records whose key is not landed yet (idempotent reload).

    Keys compare null-safely, so a record without a key is not landed again
    on every run, and within an endpoint where both sides carry one. A typed
    column named like the path is used instead of parsing the record.
    """
    def keyed(df):      # a manifest has its keys as columns
        return [(F.col(p).cast("string") if p in df.columns else
                 F.try_variant_get(F.col(RAW), f"$.{p}", "string")) for p in key_paths]
    scoped = "endpoint" in new.columns and "endpoint" in landed.columns
    have = landed.select(*[c.alias(f"_h{i}") for i, c in enumerate(keyed(landed))],
                         *([F.col("endpoint").alias("_h_endpoint")] if scoped else [])).distinct()
    n = new.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(keyed(new))])
    on = reduce(lambda a, b: a & b, [F.col(f"_k{i}").eqNullSafe(F.col(f"_h{i}")) for i in range(len(key_paths))])
    if scoped:
        on = on & F.col("endpoint").eqNullSafe(F.col("_h_endpoint"))
    return n.join(have, on, "left_anti").select(*new.columns)


def missing_keys(source: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Source keys not loaded yet."""
    return source.select(key).distinct().join(loaded.select(key), [key], "left_anti")


def backfill_keys(source: DataFrame, loaded: DataFrame, key: str, part: str,
                  expected: Sequence[str]) -> DataFrame:
    """Work list = new keys ∪ (loaded keys missing an expected part).

    ``loaded`` holds ``(key, part)`` pairs. Output ``(key, reason, missing)``
    with one row per missing part. The per-key part set is bounded by
    ``expected`` (collect_set of at most len(expected) values).
    """
    exp = F.array(*[F.lit(e) for e in expected])
    new = missing_keys(source, loaded, key).select(key, F.lit("new").alias("reason"),
                                                   F.lit(None).cast("string").alias("missing"))
    # keys that hold none of the expected parts stay in: they miss them all
    have = (loaded.groupBy(key).agg(F.collect_set(F.when(F.col(part).isin(list(expected)), F.col(part))).alias("_have"))
            .join(source.select(key).distinct(), [key], "left_semi"))
    incomplete = have.select(key, F.explode(F.array_except(exp, F.col("_have"))).alias("missing")) \
        .select(key, F.lit("incomplete").alias("reason"), "missing")
    return new.unionByName(incomplete)


def load_report(accepted: DataFrame, rejected: DataFrame, skipped: DataFrame | None = None,
                work: DataFrame | None = None) -> DataFrame:
    """Per (endpoint, session): rows loaded, skipped (already landed) and rejected, and a status.

    ``error`` if anything was rejected, ``loaded`` if rows came, ``skipped``
    if all were landed before, ``missing`` for a (endpoint, session_key) of
    ``work`` that sent nothing. Rejected lines have no session of their own;
    they never stop the report of the others.
    """
    def counted(df, kind, key):
        return df.select("endpoint", key.alias("session_key"), F.lit(kind).alias("_kind"))
    parts = [counted(accepted, "rows", lenient_key()), counted(rejected, "errors", F.lit(None).cast("int"))]
    if skipped is not None:
        parts.append(counted(skipped, "skipped", lenient_key()))
    if work is not None:
        parts.append(counted(work, "work", F.col("session_key").cast("int")))
    g = reduce(DataFrame.unionByName, parts).groupBy("endpoint", "session_key").agg(
        *[F.count_if(F.col("_kind") == k).alias(k) for k in ("rows", "skipped", "errors")])
    return g.withColumn("status", F.when(F.col("errors") > 0, "error").when(F.col("rows") > 0, "loaded")
                        .when(F.col("skipped") > 0, "skipped").otherwise("missing"))
