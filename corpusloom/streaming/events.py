"""Windows over an event stream; an extension beside the engine's batch operators.

Each function takes a batch or a streaming DataFrame of (ts, user_id, event_type,
value). Streams get a watermark, so state for old windows is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENESS = "1 hour"


def _marked(events: DataFrame, lateness: str) -> DataFrame:
    # a batch keeps its own type of timestamp; watermarks want one with a time zone
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", lateness) if events.isStreaming else e


def _counted(windows, by: str) -> DataFrame:
    out = windows.agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), by, "events", "total")


def tumbling(events: DataFrame, size: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    return _counted(_marked(events, lateness).groupBy(F.window("ts", size).alias("w"), "event_type"), "event_type")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    return _counted(_marked(events, lateness).groupBy(F.window("ts", size, slide).alias("w"), "event_type"), "event_type")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Per user: runs of events less than gap apart."""
    return _counted(_marked(events, lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id"), "user_id")


_SUMS = "count(*) AS events, round(sum(value), 4) AS total"
ORACLE_SQL = {
    "event_tumbling": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, {_SUMS} FROM events GROUP BY ALL",
    "event_sliding": f"WITH s AS (SELECT time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES * o AS start, event_type, value FROM events, (VALUES (0), (1)) v(o)) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, {_SUMS} FROM s GROUP BY ALL",
    "event_sessions": f"""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, min(ts) AS b, {_SUMS} FROM s GROUP BY ALL)
SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS start, user_id, events, total FROM c""",
}
