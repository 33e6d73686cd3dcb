"""Measures of several facts side by side, and standings at the last session."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pitwall.plans import semantic
from pitwall.plans.semantic import AT_LAST, LogicalTable, Measure, Relationship, SemanticModel, cross_fact, metric

MODEL = SemanticModel({t.name: t for t in [
    LogicalTable("stops", ("session_key", "team"), (), (Measure("n", "sum"), Measure("t", "min"))),
    LogicalTable("laps", ("session_key", "team"), (), (Measure("t", "min", ("time",)),)),
    LogicalTable("standing", ("session_key", "team", "driver"), (), (Measure("points", "max"),)),
    LogicalTable("sessions", ("session_key", "year"), primary_key=("session_key",)),
    LogicalTable("entries", ("session_key", "colour"), primary_key=("session_key", "team"))]},
    [Relationship(t, "sessions", ("session_key",)) for t in ("stops", "laps", "standing")]
    + [Relationship("laps", "entries", ("session_key",))])


@pytest.fixture(scope="module")
def marts(spark):
    tables = {
        "stops": spark.createDataFrame([(1, "a", 2, 9), (1, "a", 3, 8), (2, None, 5, 7)], "session_key int, team string, n int, t int"),
        "laps": spark.createDataFrame([(1, "a", 50), (1, "a", 40), (2, "b", 30), (2, None, 20)], "session_key int, team string, t int"),
        "standing": spark.createDataFrame([(1, "a", "x", 9), (1, "a", "y", 8), (2, "a", "x", 3), (2, "a", "y", 4), (1, "b", "z", 6)],
                                          "session_key int, team string, driver string, points int"),
        "sessions": spark.createDataFrame([(1, 2023), (2, 2023)], "session_key int, year int"),
        "entries": spark.createDataFrame([(1, "red"), (1, "blue")], "session_key int, colour string")}
    return SimpleNamespace(get=tables.get)


def test_facts_side_by_side(marts):
    got = cross_fact(marts, {"stops": ["n", "t"], "laps": ["time"]}, ["year", "team"], model=MODEL)
    assert got.columns == ["year", "team", "n", "stops_t", "laps_t"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(2023, "a", 5, 8, 40), (2023, None, 5, 7, 20), (2023, "b", None, None, 30)], key=str)


def test_filters_belong_to_their_table(marts):
    got = cross_fact(marts, {"stops": ["n"], "laps": ["t"]}, ["team"], {"laps": F.col("t") < 25}, MODEL)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 5, None), (None, 5, 20)], key=str)


def test_standing_at_the_last_session(marts):
    by_team = metric(marts, "standing", ["points"], ["team"], model=MODEL, aggregations={"points": AT_LAST})
    assert {tuple(r) for r in by_team.collect()} == {("a", 7), ("b", 6)}        # not 9, the maximum, nor 24, the sum
    assert {tuple(r) for r in metric(marts, "standing", ["points"], ["team"], model=MODEL).collect()} == {("a", 9), ("b", 6)}
    both = metric(marts, "stops", ["n", "t"], ["team"], model=MODEL, aggregations={"t": AT_LAST})
    assert {(r["team"], r["n"], r["t"]) for r in both.collect()} == {("a", 5, 17), (None, 5, 7)}


def test_joins_that_multiply_rows_are_refused(marts):
    with pytest.raises(ValueError):
        metric(marts, "laps", ["t"], ["colour"], model=MODEL)
    with pytest.raises(KeyError):
        cross_fact(marts, {"stops": ["n"], "laps": ["t"]}, ["driver"], model=MODEL)


def test_relationships_of_the_model_reach_unique_keys():
    for r in semantic.MODEL.relationships:
        key = semantic.MODEL.tables[r.right].primary_key
        assert key and set(key) <= set(r.on)
