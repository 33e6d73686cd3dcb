"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Engine settings the library's plans assume. Broadcasts need a size check:
# at planning time only sides estimated (from file sizes) under 10 MB; at
# runtime AQE broadcasts a side whose *measured* shuffle output is under
# 64 MB, otherwise the join stays sort-merge. Exploded sides (range-join
# buckets, resampling grids) are hinted to shuffle because the planner's
# estimate ignores the explode. AQE also splits skewed shuffle partitions.
ENGINE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "pitwall", cores: int | str = 8,
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (a cluster passes its own)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(ENGINE_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("PITWALL_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session. Where it is unset, a
    private scratch folder is created and registered, but only for a local
    master: executors elsewhere would each write to their own disk.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="pitwall-ckpt-")
        sc.setCheckpointDir(d)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, name: str, run_dir: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared checkpoint folder and read it
    back: later plans start from files (column pruning, pushdown, runtime
    size statistics for AQE) instead of recomputing the lineage."""
    spark = df.sparkSession
    base = run_dir or f"{checkpoint_dir(spark).rstrip('/')}/pitwall-{uuid.uuid4().hex}"
    path = f"{base}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def parts_for(spark: SparkSession, rows: int | None, per_task: int) -> int | None:
    """Number of partitions that leave each about ``per_task`` rows, or None where the session's own number does."""
    parts = -(-(rows or 0) // per_task)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def cut_lineage(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)
