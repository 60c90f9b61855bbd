"""Session numbers of a stream's rows, by the batch rule, from state kept by user."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tributary.operators.sessions import GAP_MS

#: The state store that such state needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Numbering(StatefulProcessor):
    """Holds a user's rows until the watermark has passed them, then numbers them in order."""

    def __init__(self, schema: StructType, key: str, gap_ms: int):
        self.schema, self.gap_ms = schema, gap_ms
        self.at, self.tie = schema.fieldNames().index("__ms"), schema.fieldNames().index(key)
        self.make = Row(*schema.fieldNames()[: self.at], "session")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.last = handle.getValueState("last", "ms long, session long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = [tuple(r) for r in rows]
        self.waiting.appendList(held)
        self.handle.registerTimer(min(r[self.at] for r in held))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed, held = timerValues.getCurrentWatermarkInMs(), [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in held if r[self.at] < passed), key=lambda r: (r[self.at], r[self.tie] is not None, r[self.tie]))
        if not ready:
            return
        late = [r for r in held if r[self.at] >= passed]
        if late:
            self.waiting.put(late)
            self.handle.registerTimer(min(r[self.at] for r in late))
        else:
            self.waiting.clear()
        before, session = tuple(self.last.get()) if self.last.exists() else (None, 0)
        for row in ready:
            if before is None or row[self.at] - before > self.gap_ms:
                session += 1
            before = row[self.at]
            yield self.make(*row[: self.at], session)
        self.last.update((before, session))

    def close(self) -> None:
        pass


def numbered_sessions(log: DataFrame, gap_ms: int = GAP_MS, late: str = "1 hour", time: str = "ts", key: str = "row_key") -> DataFrame:
    """Rows of a stream with session, the 1-based number of their session within the user.

    The rule is the batch one: a session ends with a gap strictly longer than ``gap_ms``, times count in
    milliseconds and ties follow ``key``.  A row comes out once the watermark (the latest time less ``late``)
    has passed it, so rows in any order get the number that they have in the whole log; rows later than that
    are dropped and counted by Spark (numRowsDroppedByWatermark), as are rows without a time.  State is a
    user's rows of the last ``late`` and one row for every user.  A user's rows of a batch meet in one task.
    The session must use the state store ``PROVIDER``.
    """
    rows = log.where(F.col(time).isNotNull()).withWatermark(time, late).withColumn("__ms", F.unix_millis(F.col(time)))
    out = StructType([*rows.schema.fields[:-1], StructField("session", LongType())])
    return rows.groupBy("user_id").transformWithState(_Numbering(rows.schema, key, gap_ms), out, "Append", "EventTime")
