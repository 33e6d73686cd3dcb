"""Streaming re-aims of the batch poll-and-insert loaders (ST1-ST4).

* ST1 ``incremental_land``: new endpoint files → RAW, exactly once per file.
  The file source tracks processed files in the checkpoint; each micro-batch
  is written to its own ``_run=<query>/_batch=<id>`` partition with overwrite,
  so a replayed batch rewrites the same folder instead of duplicating rows,
  while another source or a new checkpoint has another query and never
  overwrites what is landed.
* ST2 ``upsert_latest``: latest-per-key over an unbounded correction
  horizon without state: the batch is staged, merged with the affected
  partitions of the staged table, deduplicated again and written back with
  dynamic partition overwrite. The stream's table has a fixed number of
  partitions by hash of the session, so its files do not grow with sessions.
* ST3 ``first_wins``: bounded-state dedupe with a watermark.
* ST4 ``enrich_stream``: stream–static left lookup of a dimension.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pitwall.operators.dedupe import latest_per_key, row_hash
from pitwall.operators.joins import enrich
from pitwall.plans.staging import StagingModel, stage
from pitwall.session import cut_lineage
from pitwall.sources.landing import parse_records, with_session_key

FOLDER, FOLDERS = "_folder", 64     # partition column of a streamed staged table, and how many there are


def incremental_land(spark: SparkSession, src_dir: str, endpoint: str, raw_dir: str, checkpoint: str,
                     rejects_dir: str | None = None, available_now: bool = True,
                     max_files_per_trigger: int | None = None) -> StreamingQuery:
    """ST1: land every new file of ``src_dir/endpoint`` into ``raw_dir``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(f"{src_dir.rstrip('/')}/{endpoint}")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # the query's identity is kept in its checkpoint: the same on restart, new for a new checkpoint
        meta = batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"]
        run = json.loads(meta)["id"]
        accepted, rejected = parse_records(batch, endpoint)

        def put(df: DataFrame, out: str) -> None:
            (df.withColumn("_run", F.lit(run)).withColumn("_batch", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("endpoint", "_run", "_batch").parquet(out))
        put(with_session_key(accepted), raw_dir)
        if rejects_dir:
            put(rejected, rejects_dir)

    w = lines.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def upsert_latest(spark: SparkSession, batch_raw: DataFrame, model: StagingModel, staged_dir: str,
                  partition: str | None = None, sessions: DataFrame | None = None, folders: int | None = None) -> None:
    """ST2: merge a batch of RAW records into a staged table partitioned by
    ``partition`` (default: the model's first key, the session or meeting), or
    by its hash into ``folders`` partitions where its values are many; only the
    partitions the batch touches are rewritten. A table that is there keeps its
    layout. Models with a season year need the staged ``sessions``."""
    partition = partition or model.keys[0]
    new = stage(batch_raw, model, sessions)
    try:
        existing = spark.read.parquet(staged_dir)
    except AnalysisException as e:  # first run: no table (or an empty folder) yet
        if not any(m in str(e) for m in ("PATH_NOT_FOUND", "Path does not exist", "UNABLE_TO_INFER_SCHEMA")):
            raise
        existing = None
    if existing is not None and FOLDER not in existing.columns:
        folders = None
    if folders:
        new = new.withColumn(FOLDER, F.pmod(F.xxhash64(partition), F.lit(folders)).cast("int"))
        partition = FOLDER
    merged = new
    if existing is not None:
        touched = new.select(partition).distinct()
        merged = new.unionByName(existing.join(touched, [partition], "left_semi").select(*new.columns))
    # ties fall as in a full staging run: by the hash of the typed record
    apart = ("loaded_at", FOLDER, "year") if model.with_year else ("loaded_at", FOLDER)
    out = latest_per_key(merged, model.keys, tiebreak=[row_hash(merged, exclude=apart).desc()])
    if folders:
        out = out.hint("rebalance", FOLDER)
    if existing is not None:
        # the rewrite reads partitions it overwrites: cut lineage through the
        # shared checkpoint folder first
        out = cut_lineage(out, spark)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(staged_dir)


def stage_stream(spark: SparkSession, raw_dir: str, endpoint: str, model: StagingModel, staged_dir: str,
                 checkpoint: str, available_now: bool = True,
                 sessions: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """ST2 as a stream: new RAW partitions of an endpoint → staged table.

    ``sessions`` reads the staged sessions anew for each batch (models with a
    season year). All 18 models run.
    """
    schema = spark.read.parquet(raw_dir).schema
    raw = (spark.readStream.schema(schema).parquet(raw_dir)
           .where(F.col("endpoint") == endpoint).select("raw_data", "loaded_at"))
    w = (raw.writeStream.foreachBatch(lambda b, _id: upsert_latest(
            spark, b, model, staged_dir, sessions=sessions() if sessions else None, folders=FOLDERS))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def first_wins(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str = "10 minutes") -> DataFrame:
    """ST3: drop re-sent records (same keys) within the watermark delay; state is bounded by it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def enrich_stream(stream: DataFrame, dim: DataFrame, on: Sequence[str],
                  cols: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """ST4: stream ⟕ static dimension (re-read per micro-batch)."""
    return enrich(stream, dim, on, cols)
