"""Corpus pipeline: stages over ``documents``, each calling one operator of ``pitwall.llm``.

Stages work on every row the stage before kept and return the columns of
``documents`` (the last adds shard and slot). Extra columns pass through,
whatever their names: a stage sees them by position. Empty tables give empty
results.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwall.llm import common, decontaminate, language, mixing, sharding, simhash

USED = ("doc_id", "text", "lang", "source")     # columns that stages read


def extra_by_position(stage):
    """A stage that keeps the columns of its input, with the extra ones named by position inside it."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = [c if c in USED else f"extra{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*inside), sf_dir).toDF(*docs.columns)
    return run_stage


@extra_by_position
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rows whose text has no language (null or without a letter, ``und``) go."""
    may_learn = F.col("doc_id").isNotNull() & ~language.held_out("doc_id")
    model = language.train(docs, "text", "lang", may_learn)
    told = language.identify(docs, model, keep=tuple(docs.columns), names=("_lang_pred", "_lang_score"))
    if not model[0]:    # nothing to learn from: only texts without a letter are rejected
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return told.filter(F.col("_lang_pred") != language.UNKNOWN).drop("_lang_pred", "_lang_score")


@extra_by_position
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one row of each component stays.

    It is a row of the component's smallest doc_id (null only if all are
    null), of several the one with the smallest text hash, of equal rows any.
    """
    groups = common.store(simhash.simhash_groups(docs.select("doc_id", "text")), "components")
    first = (groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy("component_root", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
             .groupBy("component_root").agg(F.min(F.struct("doc_id", "text_hash", "rows")).alias("one")))
    kept = common.store(first.select(F.col("one.doc_id").alias("_kept_id"), F.col("one.text_hash").alias("_kept_hash"),
                                     F.col("one.rows").alias("_kept_rows")), "kept")
    joined = docs.withColumn("_hash", common.text_hash(F.col("text"))).join(
        kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_hash") == F.col("_kept_hash")))
    equal = Window.partitionBy("doc_id", "_hash").orderBy("text")
    one = joined.filter("_kept_rows > 1").withColumn("_nth", F.row_number().over(equal)).filter("_nth = 1").drop("_nth")
    return joined.filter("_kept_rows = 1").unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])


@extra_by_position
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(docs, benchmark)
    bad = common.store(found.select(F.col("id").alias("_bad_id"), F.col("hash").alias("_bad_hash")).distinct(),
                       "contaminated")
    return docs.withColumn("_hash", common.text_hash(F.col("text"))).join(
        bad, F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.col("_hash") == F.col("_bad_hash")), "left_anti"
    ).drop("_hash")


@extra_by_position
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: all rows and columns with their shard and slot."""
    return sharding.shard_rows(docs)


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

# The stages hold a fitted classifier, components, retrieval and a seeded
# shuffle, which SQL cannot express; tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
