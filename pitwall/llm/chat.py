"""Chat formatting by cumulative-snapshot collapse (operator 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import store

TURN = "<|im_start|>%s\n%s<|im_end|>\n"


def maximal_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_snapshots): logged conversations that prefix no longer one.

    A conversation is its turns in (turn, role, text) order, nulls first. Its
    rolling hash after turn i covers roles and texts of turns 1..i. It is
    dropped when its last rolling hash is an inner one of another (a strict
    prefix), or equals the last one of a conversation with a smaller id (an
    equal copy). ``n_snapshots`` counts the conversations equal to it, itself
    included. Rows without a conversation id belong to no conversation. Null
    roles and texts are values of their own. An empty table gives no rows.
    """
    t = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"))
    one = F.sha2(F.to_json(F.struct("role", "text")), 256).alias("h")
    steps = (t.select("conv", "turn", "role", F.xxhash64("text").alias("x"), one)
             .groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "x", "h"))).alias("s"))
             .select("conv", F.size("s").alias("n"), F.aggregate(
                 "s", F.array().cast("array<string>"),
                 lambda acc, x: F.concat(acc, F.array(F.md5(F.concat(
                     F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")), x["h"]))))).alias("rolling")))
    steps = store(steps, "rolling-hashes")
    ends = steps.select("conv", "n", F.element_at("rolling", -1).alias("end"))
    inner = (steps.select(F.explode(F.slice("rolling", 1, F.col("n") - 1)).alias("end")).distinct())
    longest = ends.join(inner, "end", "left_anti")
    return longest.groupBy("end").agg(F.min("conv").alias(conv_col), F.first("n").alias("n_turns"),
                                      F.count("*").alias("n_snapshots")).drop("end")


def render_maximal(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_snapshots, chat): each maximal conversation rendered as one text.

    Turns are written in the same order as they are hashed; a null role is
    written as ``unknown`` and a null text as nothing.
    """
    keep = maximal_conversations(turns, conv_col, turn_col, role_col, text_col)
    t = turns.select(F.col(conv_col).alias(conv_col), F.col(turn_col).alias("_turn"),
                     F.col(role_col).cast("string").alias("_role"), F.col(text_col).cast("string").alias("_text"))
    kept = t.join(keep.select(conv_col), conv_col, "left_semi")
    whole = (kept.groupBy(conv_col)
             .agg(F.sort_array(F.collect_list(F.struct("_turn", "_role", F.xxhash64("_text").alias("x"), "_text")))
                  .alias("s"))
             .select(conv_col, F.array_join(F.transform("s", lambda p: F.format_string(
                 TURN, F.coalesce(p["_role"], F.lit("unknown")), F.coalesce(p["_text"], F.lit("")))), "")
                 .alias("chat")))
    return whole.join(keep, conv_col).select(conv_col, "n_turns", "n_snapshots", "chat")
