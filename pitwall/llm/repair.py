"""Conversation structure repair over a suffix-shared automaton (operator 12).

A conversation's rows become a signature: one letter per row for its role and
fault. Signatures are cut into blocks of BLOCK rows, so that no conversation
is ever one row, and the distinct block signatures of all conversations are
minimised from the end: a node of the automaton is a suffix, shared by every
signature that ends with it. Per node and grammar state the cheapest edits to
the end of the block are computed once (``suffix_costs``); blocks of one
conversation are then combined by min-plus products, level by level.

The grammar of role initials is ``(s?(ua)+)?``: states START, SYSTEM (after
s), USER (after u) and ASSISTANT (after a complete pair); START and ASSISTANT
accept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import importable, store
from pitwall.operators.timeseries import seq_index

WORDED = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
BLOCK = 128             # rows of a conversation in one signature
FAN = 128               # blocks combined at once
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5      # costs
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
DUE = ("u", "u", "a", "u")                                  # role that a rerole or an insert must have
NEXT = (USER, USER, ASSISTANT, USER)
# A plan has a letter per edit: K keep, D delete, u and a rerole, U and A insert. Its audit has the edits' initials.
AUDIT = str.maketrans("uaUA", "RRII")
END = ((0, ""), (2 * INSERT, "UA"), (INSERT, "A"), (0, ""))   # cost and plan from each state at the end

Best = tuple[int, str]


def suffix_costs(after: list[dict[int, Best]], letter: str) -> list[dict[int, Best]]:
    """Cheapest (cost, plan) from each grammar state to each state at the block's end.

    ``after`` is the same for the suffix without its first row, ``letter``
    that row: D must be deleted (blank or duplicate); s, u, a, x are role
    initials (x: no legal role), in upper case if the text is truncated.
    Ties go to the audit that is least in ASCII.
    """
    role, cut = letter.lower(), TRUNCATED * (letter.isupper() and letter != "D")
    rest = []
    for g in STATES:
        moves = [(DELETE, "D", after[g])]
        if letter != "D":
            moves.append((REROLE + cut, DUE[g], after[NEXT[g]]))
            if (g, role) in KEPT:
                moves.append((KEEP + cut, "K", after[KEPT[g, role]]))
        rest.append(cheapest(moves))
    one = [cheapest([(0, "", rest[g]), (INSERT, DUE[g].upper(), rest[NEXT[g]])]) for g in STATES]
    return [cheapest([(0, "", rest[g]), (INSERT, DUE[g].upper(), one[NEXT[g]])]) for g in STATES]


def cheapest(moves: list[tuple[int, str, dict[int, Best]]]) -> dict[int, Best]:
    out: dict[int, Best] = {}
    for cost, plan, rest in moves:
        for t, (c, p) in rest.items():
            new = (cost + c, plan + p)
            if t not in out or (new[0], new[1].translate(AUDIT)) < (out[t][0], out[t][1].translate(AUDIT)):
                out[t] = new
    return out


def solve_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, g, t, cost, plan, nth) of signatures that arrive sorted by their reversal.

    Neighbours in that order share the longest suffixes, so a stack with the
    values of the last signature's suffixes visits every node once. ``nth``
    numbers the plans from one state g by their audits.
    """
    done, stack = "", [[{g: (0, "")} for g in STATES]]
    for batch in batches:
        out = {"sig": [], "g": [], "t": [], "cost": [], "plan": [], "nth": []}
        for sig in batch.column("sig").to_pylist():
            back = sig[::-1]
            same = 0
            while same < min(len(done), len(back)) and done[same] == back[same]:
                same += 1
            del stack[same + 1:]
            for letter in back[same:]:
                stack.append(suffix_costs(stack[-1], letter))
            done = back
            for g in STATES:
                order = sorted(stack[-1][g].items(), key=lambda x: x[1][1].translate(AUDIT))
                for nth, (t, (cost, plan)) in enumerate(order):
                    for k, v in zip(out, (sig, g, t, cost, plan, nth)):
                        out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=SOLVED)


SOLVED = pa.schema([("sig", pa.string()), ("g", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()),
                    ("plan", pa.string()), ("nth", pa.int32())])
STEPS = "array<struct<g:int,t:int,cost:bigint,nth:int>>"
Steps = dict[tuple[int, int], tuple[int, int]]


def table(steps) -> Steps:
    return {(s["g"], s["t"]): (s["cost"], s["nth"]) for s in steps}


def best_path(parts: list[Steps], g: int, t: int) -> tuple[int, list[int]] | None:
    """(cost, states after each part) of the cheapest way from g to t, ties to the least audit."""
    togo: list[dict[int, tuple[int, int, int]]] = [{t: (0, 0, t)}]
    for part in reversed(parts):
        here: dict[int, tuple[int, int, int]] = {}
        for (a, b), (cost, nth) in part.items():
            if b in togo[-1]:
                new = (cost + togo[-1][b][0], nth, b)
                if a not in here or new < here[a]:
                    here[a] = new
        togo.append(here)
    if g not in togo[-1]:
        return None
    cost, path = togo[-1][g][0], []
    for here in reversed(togo[1:]):
        g = here[g][2]
        path.append(g)
    return cost, path


def combine(pdf: pd.DataFrame) -> pd.DataFrame:
    """Steps of FAN neighbouring parts as the steps of one part."""
    parts = [table(s) for s in pdf.sort_values("part")["steps"]]
    out = []
    for g in STATES:
        found = [(t, p) for t in STATES if (p := best_path(parts, g, t))]
        audits = sorted(found, key=lambda x: [part[edge][1] for part, edge in zip(parts, zip([g, *x[1][1]], x[1][1]))])
        out += [{"g": g, "t": t, "cost": cost, "nth": nth} for nth, (t, (cost, _)) in enumerate(audits)]
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "part": [int(pdf["part"].iloc[0]) // FAN], "steps": [out]})


def descend(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states before and after each of FAN neighbouring parts, from those of the whole."""
    pdf = pdf.sort_values("part")
    parts = [table(s) for s in pdf["steps"]]
    g = int(pdf["g"].iloc[0])
    path = best_path(parts, g, int(pdf["t"].iloc[0]))[1]
    return pd.DataFrame({"key": pdf["key"], "part": pdf["part"], "g": [g, *path[:-1]], "t": path})


def whole_ways(levels: DataFrame) -> DataFrame:
    """(key, part, g, t) of conversations that are one part: from START to the cheapest accepted end."""
    last = F.element_at(F.array(*[F.lit(c) for c, _ in END]), F.col("s.t") + 1)
    tail = F.element_at(F.array(*[F.lit(p) for _, p in END]), F.col("s.t") + 1)
    return (levels.select("key", "part", F.explode("steps").alias("s")).filter(F.col("s.g") == START)
            .groupBy("key", "part").agg(F.min(F.struct((F.col("s.cost") + last).alias("c"), "s.nth",
                                                       tail.alias("p"), "s.t")).alias("m"))
            .select("key", "part", F.lit(START).alias("g"), F.col("m.t").alias("t")))


def ways(blocks: DataFrame) -> DataFrame:
    """(key, part, g, t): the grammar states around each block of every conversation.

    ``blocks`` holds (key, part, steps). Conversations of one block are
    decided at once. Longer ones are combined FAN blocks at a time until one
    part is left, and the decision is carried down the same levels.
    """
    several = blocks.filter("part > 0").select("key").distinct()
    out = whole_ways(blocks.join(several, "key", "left_anti"))
    level = store(blocks.join(several, "key", "left_semi").select("key", "part", "steps"), "parts")
    levels = [level]
    while level.filter("part > 0").limit(1).count():
        up = level.withColumn("up", F.floor(F.col("part") / FAN)).groupBy("key", "up").applyInPandas(
            combine, f"key string, part long, steps {STEPS}")
        level = store(up, "parts")
        levels.append(level)
    way = whole_ways(level)
    for below in levels[-2::-1]:
        at = F.floor(F.col("part") / FAN)
        met = below.withColumn("up", at).join(way.withColumnRenamed("part", "up"), ["key", "up"])
        way = store(met.groupBy("key", "up").applyInPandas(descend, "key string, part long, g int, t int"), "ways")
    return out.unionByName(way)


def key_of(c: Column) -> Column:
    """A conversation id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def checked_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(key, conv, turn, role, text, at, fault, letter, initial): rows with their place and fault.

    ``at`` counts from 0 in (turn nulls first, role, text) order. Null roles
    and texts are one space. ``fault`` is blank, duplicate or truncated (the
    first that holds) or null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = turns.select(key_of(F.col(conv_col)).alias("key"), F.col(conv_col).alias("conv"),
                     F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    t = seq_index(t, ["key"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "at", 0)
    t = store(t.withColumn("what", F.sha2("text", 256)), "turns")
    said = t.groupBy("key", "role", "what").agg(F.min("at").alias("first"))
    t = t.join(said, ["key", "role", "what"])
    fault = (F.when(~F.col("text").rlike(WORDED), "blank").when(F.col("at") > F.col("first"), "duplicate")
             .when(~F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1).isin(*ENDINGS), "truncated"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return t.withColumn("fault", fault).drop("what", "first").withColumn("initial", initial).withColumn(
        "letter", F.when(F.col("fault").isin("blank", "duplicate"), "D")
        .when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter))


def plans(checked: DataFrame) -> DataFrame:
    """(key, part, illegal, cost, plan, last): per block of every conversation the edits that are made.

    ``illegal`` counts neighbours whose role initials are not su, ua or au
    (the block's last row with the next block's first one included).
    """
    spark = checked.sparkSession
    importable(spark)
    part = F.floor(F.col("at") / BLOCK)
    # a block's first row is also shown to the block before it
    seen = F.when((F.col("at") % BLOCK == 0) & (F.col("at") > 0), F.array(part, part - 1)).otherwise(F.array(part))
    rows = checked.select("key", "at", "letter", "initial", part.alias("own"), F.explode(seen).alias("part"))
    letters = rows.groupBy("key", "part").agg(F.sort_array(F.collect_list(F.struct(
        "at", F.when(F.col("own") == F.col("part"), F.col("letter")).otherwise("").alias("letter"), "initial"))).alias("r"))
    legal = F.transform(F.sequence(F.lit(2), F.size("r")), lambda i: F.concat(
        F.element_at("r", i - 1)["initial"], F.element_at("r", i)["initial"]).isin("su", "ua", "au"))
    blocks = store(letters.select("key", "part", F.array_join(F.col("r.letter"), "").alias("sig"),
                                  F.when(F.size("r") < 2, 0).otherwise(F.size(F.filter(legal, lambda x: ~x)))
                                  .cast("long").alias("illegal")), "blocks")
    # suffixes are shared inside a task: signatures with the same last letters go to the same one
    sigs = blocks.select("sig").distinct().withColumn("back", F.reverse("sig"))
    solved = store(sigs.repartition(F.substring("back", 1, 8)).sortWithinPartitions("back").select("sig")
                   .mapInArrow(solve_signatures, "sig string, g int, t int, cost long, plan string, nth int"), "solved")
    steps = solved.groupBy("sig").agg(F.collect_list(F.struct("g", "t", "cost", "nth")).alias("steps"))
    way = store(ways(blocks.join(steps, "sig").select("key", "part", "steps")), "way")
    return blocks.join(way, ["key", "part"]).join(solved.drop("nth"), ["sig", "g", "t"]).select(
        "key", "part", "illegal", "cost", "plan", F.col("t").alias("last"))


def closed(planned: DataFrame) -> DataFrame:
    """``planned`` with the inserts at the end of each conversation in its last block."""
    ends = planned.groupBy("key").agg(F.max("part").alias("part")).withColumn("is_last", F.lit(True))
    at_end = lambda k: F.element_at(F.array(*[F.lit(e[k]) for e in END]), F.col("last") + 1)
    return planned.join(ends, ["key", "part"], "left").withColumn(
        "cost", F.when(F.col("is_last"), F.col("cost") + at_end(0)).otherwise(F.col("cost"))).withColumn(
        "tail", F.when(F.col("is_last"), at_end(1)).otherwise("")).drop("is_last", "last")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(reports, repaired turns) of all conversations.

    Reports have one row per conversation id (null is one of its own): gaps,
    blank, duplicate, truncated, illegal, cost and audit, the cheapest edits'
    initials in order. Repaired turns are (conv, at, nth, role, text, edit):
    kept and reroled rows at their place, inserted ones (empty text, edit I)
    before the row at ``at`` in the order of ``nth``; deleted rows are absent.
    Repeated rows are rows of their own (so the later one is a duplicate),
    rows equal in turn are ordered by role and text, roles other than those
    that begin with s, u or a can only be reroled or deleted. Columns beside
    the four named are ignored. An empty table gives no rows. No task holds
    more than BLOCK rows of one conversation at once.
    """
    checked = store(checked_turns(turns, conv_col, turn_col, role_col, text_col), "checked")
    planned = store(closed(plans(checked)), "plans")
    n = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    faults = checked.groupBy("key").agg(F.first("conv").alias("conv"), gaps.alias("gaps"), n("blank"), n("duplicate"),
                                        n("truncated"))
    audit = F.translate(F.concat("plan", "tail"), "uaUA", "RRII")
    edits = planned.groupBy("key").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("part", audit.alias("a")))), lambda x: x["a"]), "").alias("audit"))
    reports = faults.join(edits, "key").drop("key")

    # the letters of a plan, cut after each row's own edit; what follows the last one is inserted at the end
    cut = F.transform(F.regexp_extract_all("plan", F.lit("[UA]*[KDua]"), F.lit(0)), lambda e: e)
    each = planned.select("key", "part", F.posexplode(cut).alias("i", "edits")).select(
        "key", (F.col("part") * BLOCK + F.col("i")).alias("at"), "edits")
    done = checked.select("key", "conv", "at", "role", "text").join(each, ["key", "at"])
    tails = (planned.filter("tail <> ''").join(checked.groupBy("key").agg(F.first("conv").alias("conv"),
                                                                         (F.max("at") + 1).alias("at")), "key")
             .select("conv", "at", F.lit("").alias("role"), F.lit("").alias("text"), F.col("tail").alias("edits")))
    letters = (done.select("conv", "at", "role", "text", "edits").unionByName(tails)
               .select("conv", "at", "role", "text", F.posexplode(F.split("edits", "")).alias("nth", "e"))
               .filter("e <> '' AND e <> 'D'"))
    e = F.col("e")
    return reports, letters.select(
        "conv", "at", "nth", F.when(e == "K", F.col("role")).when(F.lower(e) == "u", "user").otherwise("assistant")
        .alias("role"), F.when(e.isin("U", "A"), "").otherwise(F.col("text")).alias("text"),
        F.translate(e, "uaUA", "RRII").alias("edit"))


def digests(repaired: DataFrame) -> DataFrame:
    """(key, sha256) of the repaired rows of each conversation as ``role:text`` lines.

    Rows stream through their task in order, so a conversation of any length
    is hashed in bounded memory (a digest of one text is sequential by nature).
    """
    importable(repaired.sparkSession)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, sha = None, None
        for batch in batches:
            out = {"key": [], "repaired_sha256": []}
            for key, line in zip(*(c.to_pylist() for c in batch.columns)):
                if key != open_key:
                    if sha:
                        out["key"].append(open_key)
                        out["repaired_sha256"].append(sha.hexdigest())
                    open_key, sha = key, hashlib.sha256(line.encode())
                else:
                    sha.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        if sha:
            yield pa.RecordBatch.from_pydict({"key": [open_key], "repaired_sha256": [sha.hexdigest()]}, schema=schema)

    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])
    lines = repaired.select(key_of(F.col("conv")).alias("key"), "at", "nth", F.concat("role", F.lit(":"), "text").alias("l"))
    return (lines.repartition("key").sortWithinPartitions("key", "at", "nth").select("key", "l")
            .mapInArrow(stream, "key string, repaired_sha256 string"))


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Rows damaged by crc32(``conv:turn``) % 20: 0 drops a row, 1 empties its text, 2 removes its sentence
    ends, 3 repeats it, 4 makes it the user's. Nulls in the key, role and text are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(space(text_col), "[.!?]", "")).otherwise(space(text_col))
    return (turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                         F.when(how == 4, "user").otherwise(space(role_col)).alias("role"), text.alias("text"),
                         F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"))
            .select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_")).drop("_"))
