"""As-of join of two streams (J8 as a stream).

Both sides are one stream of (keys, time, side, payload) rows under one
watermark. A stateful processor holds, per key, the right rows since the last
settled instant and the left rows that wait; an event-time timer at the
earliest waiting left row fires when the watermark has passed it, that is when
every right row at or before it has arrived. So the result does not depend on
the order of arrival within the watermark delay. Settled right rows but the
last one leave the state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from pitwall.operators.joins import epoch_micros

LEFT, RIGHT, TICK = 1, 0, 2
ROW = "at long, row string"
# JSON keeps times as text to the microsecond
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Asof(StatefulProcessor):
    """Waiting left rows and unsettled right rows of one key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.right = handle.getListState("right", ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        left, right = [], []
        for part in rows:
            for at, side, row in zip(part["at"], part["side"], part["row"]):
                if side != TICK:
                    (left if side == LEFT else right).append((int(at), row))
        if right:
            self.right.appendList(right)
        if left:
            self.waiting.appendList(left)
            self._wake(min(at for at, _ in left))
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)       # timers are in milliseconds, rows in microseconds

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((r[0], r[1]) for r in self.waiting.get())
        ready = [r for r in waiting if r[0] < settled]
        if not ready:
            return
        right = sorted((r[0], r[1]) for r in self.right.get())
        out, i = [], 0
        for at, row in ready:
            while i < len(right) and right[i][0] <= at:
                i += 1
            out.append((row, right[i - 1][1] if i else None))
        rest = waiting[len(ready):]
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
        # later left rows are at or after the watermark: of the settled right rows only the last can match them
        past = sum(at < settled for at, _ in right)
        if past > 1:
            self.right.put(right[past - 1:])
        yield pd.DataFrame(out, columns=["left_row", "right_row"])

    def close(self) -> None:
        pass


def asof_stream(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str,
                delay: str = "1 hour") -> DataFrame:
    """Backward as-of left join of streams: each left row once, with the latest right row of its keys at or before it.

    Rows come out when the watermark (latest time seen less ``delay``) has passed them; rows later than that are
    dropped. Among right rows of equal time the largest (as JSON text) wins. Rows without a key or time only move the
    watermark. The session must use the RocksDB state store (``STATE_STORE``).
    """
    def side(df: DataFrame, ts: str, what: int) -> DataFrame:
        known = F.lit(True)
        for k in on:
            known = known & F.col(k).isNotNull()
        t = df.schema[ts].dataType
        return df.select(F.to_json(F.struct(*on)).alias("key"), F.col(ts).cast("timestamp").alias("event_time"),
                         epoch_micros(F.col(ts), t).cast("long").alias("at"),
                         F.when(known, F.lit(what)).otherwise(F.lit(TICK)).alias("side"),
                         F.to_json(F.struct(*df.columns), TIMES).alias("row"))

    both = side(left, left_ts, LEFT).unionByName(side(right, right_ts, RIGHT)).withWatermark("event_time", delay)
    found = both.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Asof(), outputStructType=StructType([StructField("left_row", StringType()),
                                                               StructField("right_row", StringType())]),
        outputMode="Append", timeMode="EventTime")
    schema = lambda df: StructType([StructField(f.name, f.dataType) for f in df.schema.fields])
    return found.select(F.from_json("left_row", schema(left), TIMES).alias("l"),
                        F.from_json("right_row", schema(right), TIMES).alias("r")).select(
        *[F.col(f"l.`{c}`").alias(c) for c in left.columns],
        *[F.col(f"r.`{c}`").alias(c) for c in right.columns if c not in on])
