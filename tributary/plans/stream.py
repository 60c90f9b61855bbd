"""Queries over given tables that are read as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tributary.operators.prefix import shared_dir
from tributary.plans import bind as B
from tributary.plans.bind import sql
from tributary.streaming import PROVIDER, numbered_sessions

QUERIES, ORACLE_SQL = {}, {}

_LATE_MS = 3_600_000
ORACLE_SQL["stream_session_numbers"] = sql(f"SELECT row_key, user_id, session FROM (SELECT row_key, user_id, time_ms, dense_rank() OVER (PARTITION BY user_id ORDER BY session_id) AS session, max(time_ms) OVER () AS latest FROM sess) WHERE time_ms < latest - {_LATE_MS}", "sess")


def stream_session_numbers(s, sf):
    """Events as a stream that ends; the rows that the watermark has passed by then."""
    schema = B.read(s, sf, "events").schema
    events = s.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")  # a stream takes one file only by a pattern
    log = events.select(F.col("event_id").alias("row_key"), "user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = f"{shared_dir(s)}/stream_session_numbers-{uuid.uuid4().hex}"
    before = s.conf.get(PROVIDER[0], None)
    s.conf.set(*PROVIDER)
    try:
        numbers = numbered_sessions(log, B.GAP_MS, f"{_LATE_MS} milliseconds").select("row_key", "user_id", "session")
        written = numbers.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
        written.awaitTermination()
    finally:
        if before is None:
            s.conf.unset(PROVIDER[0])
        else:
            s.conf.set(PROVIDER[0], before)
    return s.read.schema("row_key long, user_id long, session long").parquet(f"{out}/rows")


QUERIES["stream_session_numbers"] = stream_session_numbers
