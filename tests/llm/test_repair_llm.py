"""Conversation repair against a brute-force search over all edits."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from llm_helpers import SF_SMALL
from pitwall.llm import repair
from pitwall.llm.queries import queries

SCHEMA = "conv_id long, turn long, role string, text string, at int, plan string, key string"


def brute_audit(rows):
    """(cost, audit, repaired rows) of the cheapest edits; a straightforward search, row by row."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", None)}

    def put(to, state, new):
        if state not in to or new[:2] < to[state][:2]:
            to[state] = new

    def inserts(at):
        for _ in range(3):
            for last, (cost, audit, link) in list(at.items()):
                for role in ("user", "assistant"):
                    if role[0] in legal[last]:
                        put(at, role[0], (cost + 5, audit + "I", (link, role + ":")))
        return at

    for role, text, fault in rows:
        new = {}
        for last, (cost, audit, link) in inserts(best).items():
            put(new, last, (cost + 2, audit + "D", link))
            if fault not in ("blank", "duplicate"):
                cut = 5 * (fault == "truncated")
                if role[:1] and role[:1] in legal[last]:
                    put(new, role[0], (cost + cut, audit + "K", (link, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    if r[0] in legal[last]:
                        put(new, r[0], (cost + 1 + cut, audit + "R", (link, f"{r}:{text}")))
        best = new
    ends = [v for last, v in inserts(best).items() if last in ("", "a")]
    cost, audit, link = min(ends, key=lambda v: v[:2])
    lines = []
    while link:
        link, line = link
        lines.append(line)
    return cost, audit, lines[::-1]


def faults(rows):
    """[(role, text, fault)] of (turn, role, text) rows in their order."""
    seen, out = set(), []
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = ("blank" if not words else "duplicate" if (role, text) in seen
                 else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(rows):
    out = {}
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role, text))
    for conv, members in convs.items():
        f = faults(members)
        n = Counter(x[2] for x in f)
        turns = {t for t, _, _ in members if t is not None}
        cost, audit, lines = brute_audit(f)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(f, f[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"],
                     n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, lines)
    return out


def got(turns):
    reports, repaired = repair.repair(turns)
    lines = defaultdict(list)
    for r in sorted(repaired.collect(), key=lambda r: (r["at"], r["nth"])):
        lines[r["conv"]].append(f"{r['role']}:{r['text']}")
    return {r["conv"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"],
                        lines[r["conv"]]) for r in reports.collect()}


def random_rows(rng, conv, n, turns):
    return [(conv, rng.choice([None, *range(turns)]) if rng.random() < .1 else rng.randrange(turns),
             rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]),
             rng.choice(["", " \t", "a.", "b!", "c", "word word?", f"x{rng.random()}.", f"y{rng.random()}"]))
            for _ in range(n)]


def test_repair_against_search(spark):
    rng = random.Random(5)
    rows = [r for conv in range(120) for r in random_rows(rng, conv, rng.randrange(1, 12), 8)]
    rows += random_rows(rng, None, 7, 5)
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    assert got(df) == expected(rows)


@pytest.mark.parametrize("n", [repair.BLOCK, repair.BLOCK + 1, 3 * repair.BLOCK, repair.BLOCK * repair.FAN + 300])
def test_long_conversation(spark, n):
    """Blocks, and blocks of blocks, of one conversation give the edits of the whole."""
    rng = random.Random(n)
    rows = random_rows(rng, 1, n, 2 * n) + random_rows(rng, 2, 5, 5)
    # among the repeats are long stretches with no legal role at all
    rows = [(c, t, "tool" if t is not None and t % 1000 > 700 else r, x) for c, t, r, x in rows]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    assert got(df) == expected(rows)


def test_repair_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    reports, repaired = repair.repair(empty)
    assert reports.count() == 0 and repaired.count() == 0 and repair.damage(empty).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None), (3, None, "user", None, 1, "", "k"),
                                   (3, None, None, "a.", 1, "", "k")], SCHEMA)
    assert got(nulls) == expected([(None, None, " ", " "), (3, None, "user", " "), (3, None, " ", "a.")])
    long = "word " * 300_000 + "end."
    assert got(spark.createDataFrame([(1, 0, "user", long, 0, "", ""), (1, 1, "assistant", long, 0, "", "")], SCHEMA)
               ) == expected([(1, 0, "user", long), (1, 1, "assistant", long)])


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(10)] + [(None, None, None, None)]
    df = spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA)
    want = Counter()
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20
        role, text = role or " ", text or " "
        row = (conv, turn, "user" if h == 4 else role,
               "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        want[row] += {0: 0, 3: 2}.get(h, 1)
    assert Counter(map(tuple, repair.damage(df).collect())) == +want


def test_automaton_visits_every_suffix_once(spark, monkeypatch):
    """Signatures of one task share their suffixes: a node per distinct suffix."""
    import pyarrow as pa
    sigs = ["uaua", "sua", "aua", "DDua", "uaDua", "ua"]
    calls = []
    monkeypatch.setattr(repair, "suffix_costs", lambda after, letter, f=repair.suffix_costs: calls.append(1) or f(after, letter))
    batch = pa.RecordBatch.from_pydict({"sig": sorted(sigs, key=lambda s: s[::-1])})
    list(repair.solve_signatures(iter([batch])))
    assert len(calls) == len({s[i:] for s in sigs for i in range(len(s))})


def test_query_digests(spark):
    rows = [tuple(r) for r in repair.damage(spark.read.parquet(f"{SF_SMALL}/conversations.parquet")).collect()]
    want = {c: v for c, v in expected(rows).items()}
    for r in queries()["op12_conversation_repair"](spark, SF_SMALL).collect():
        w = want.get(r["conv_id"], (0, 0, 0, 0, 0, 0, "", []))
        assert tuple(r)[1:8] == w[:7]
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(w[7]).encode()).hexdigest()
