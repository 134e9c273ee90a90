"""Streaming extension query (ST1): the events table replayed as a turn stream."""

from __future__ import annotations

from ..streaming.state_stream import event_turns, run_available_now
from . import fixtures as fx
from .registry import register


@register("stream_state", """
SELECT user_id AS dialog_id, ts, 'event' AS slot, CASE WHEN event_type <> 'view' THEN event_type END AS "update",
       coalesce(last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS)
                OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'none') AS value
FROM events""")
def q_stream_state(spark, sf):
    from pyspark.sql import functions as F
    out = run_available_now(spark, event_turns(fx.read_table(spark, sf, "events")))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
