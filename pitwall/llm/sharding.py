"""Two-pass external shuffle into shards (operator 9). DataFrame functions only.

Pass 1 scatters rows uniformly into memory-sized buckets by a seeded hash.
Pass 2 gathers each bucket, puts it in a canonical order, shuffles it
(``shuffle`` with a seed is a Fisher-Yates permutation) and writes it. The
buckets laid end to end are one random order of all rows; shards are equal
runs of that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwall.llm.common import store, tasks_for

BUCKET_BYTES = 8 << 20


def shard_rows(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
               seed: int = 9, bucket_bytes: int = BUCKET_BYTES, row_bytes: int = 64) -> DataFrame:
    """All rows and columns of ``docs`` plus ``shard`` (0 .. n_shards-1) and ``slot`` (gapless from 0).

    Shard sizes differ by one row at most. Which bucket a row falls in depends
    on the row and the seed alone; the order inside a bucket is the same in
    reruns on the same files with the same number of shuffle partitions, and
    another permutation otherwise (``shuffle`` draws by partition). Equal rows
    are interchangeable; a bucket that repeats of few rows make larger than
    planned is split further, so no task holds more than a bucket. Null ids
    and texts are hashed like any value; an empty table gives no rows. Input
    columns called ``shard`` or ``slot`` are replaced.
    """
    docs = docs.drop("shard", "slot")
    cols = docs.columns
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + row_bytes
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    light = docs.select(key.alias("key"), size.alias("size"))
    total = light.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    n_buckets = max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    bucket = F.pmod(key, F.lit(n_buckets))
    # Only repeats of the same id and text can make a bucket this large; the
    # list holds at most bytes / (2 * bucket_bytes) numbers.
    large = store(light.groupBy(F.pmod("key", F.lit(n_buckets)).alias("bucket")).agg(F.sum("size").alias("bytes"))
             .filter(F.col("bytes") > 2 * bucket_bytes)
             .select("bucket", F.ceil(F.col("bytes") / bucket_bytes).alias("parts")), "large-buckets")
    scattered = (docs.select(bucket.alias("bucket"), key.alias("key"), row.alias("row"))
                 .join(large, "bucket", "left")
                 .withColumn("part", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(
                     F.pmod(F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id()), F.col("parts")))))
    rows = scattered.repartition(tasks_for(docs.sparkSession), "bucket", "part")
    shuffled = (rows.groupBy("bucket", "part")
                .agg(F.sort_array(F.collect_list(F.struct("key", "row"))).alias("rows"))
                .select("bucket", "part", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("pos", "item"))
                .select("bucket", "part", F.col("pos").cast("long").alias("pos"), "item.row.*"))
    written = store(shuffled, "buckets")
    counts = written.groupBy("bucket", "part").agg(F.count("*").alias("rows"))
    order = Window.orderBy("bucket", "part")
    # one row per bucket; written, so that the join knows how small it is
    starts = store(counts.select("bucket", "part", (F.sum("rows").over(order) - F.col("rows")).alias("start")),
                   "starts")
    place = F.col("start") + F.col("pos")
    n = F.lit(total["n"])
    shard = F.floor((place * n_shards).cast("decimal(38,0)") / n).cast("long")
    first = F.ceil((F.col("shard") * n).cast("decimal(38,0)") / n_shards).cast("long")
    return (written.join(starts, ["bucket", "part"])
            .withColumn("shard", shard).withColumn("slot", place - first)
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], F.col("shard").cast("int").alias("shard"),
                    "slot"))

