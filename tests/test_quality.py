"""Null counts observed while tables are written, and the keys of failing rows."""

import tempfile

from conftest import SF_SMALL
from pitwall.catalog import ctx
from pitwall.plans import queries
from pitwall.plans.quality import Check, failing_keys, observed, run_checks

CHECKS = [Check("t", ("a",), "not_null"), Check("t", ("b",), "not_null", "warn"), Check("t", ("a",), "unique")]


def test_nulls_are_counted_by_the_write(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (None, 3), (None, None), (None, 5)], "a int, b int")
    seen_df, seen = observed(df, "t", CHECKS)
    seen_df.write.mode("overwrite").parquet(tempfile.mkdtemp(prefix="pw-dq-"))
    assert seen.get == {"a": 3, "b": 2}
    assert observed(df, "other", CHECKS) == (df, None)
    known = {"t": seen.get}
    one, two = (sorted(map(tuple, run_checks({"t": df}, CHECKS, c).collect())) for c in (None, known))
    assert one == two
    # counts say what is read: with counts of zero no row is looked for
    keys = {tuple(r) for r in failing_keys({"t": df}, CHECKS, ("a",), {"t": {"a": 0, "b": 2}}).collect()}
    assert keys == {("t", "b", "not_null", '{"a":1}', 1), ("t", "b", "not_null", '{"a":null}', 1),
                    ("t", "a", "unique", '{"a":1}', 2)}
    assert failing_keys({"t": df.limit(0)}, CHECKS[:1], counted={"t": {"a": 0}}).collect() == []


def test_report_reads_only_tables_with_unique_checks(spark):
    m = ctx(spark, SF_SMALL).marts
    read = {f.split("/")[-2] for f in queries.dq_report(m).inputFiles()}
    assert read <= {"dim_sessions", "stg_meetings", "stg_sessions"}
