"""The two streaming operators, run over the event table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.plans import views as v
from trackloom.plans.files_queries import folder
from trackloom.plans.registry import query
from trackloom.streaming import hops

DELAY_US = 3_600_000_000
ATTACK, RELEASE = 2.0, 8.0


def event_stream(t):
    """The event table as a stream of files."""
    rows = t.spark.readStream.schema(t.events.schema).option(
        "pathGlobFilter", "events.parquet"
    ).parquet(t.root)
    return rows.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100, 0).alias("value"),
    )


@query(
    "hop_rms_stream",
    f"""WITH w AS (
          SELECT user_id, (epoch_us(ts) // {v.HOP} - k) * {v.HOP} AS window_start,
                 round(value * 100, 0) AS value
          FROM events, (SELECT unnest([0, 1]) AS k))
        SELECT user_id, CAST(window_start AS BIGINT) AS window_start,
               round(sqrt(avg(value * value)), 6) AS rms
        FROM w GROUP BY 1, 2
        HAVING window_start + {2 * v.HOP} <= (SELECT max(epoch_us(ts)) FROM events) - {DELAY_US}""",
)
def hop_rms_stream(t):
    """Windows that the watermark has closed at the end of the table."""
    stream = hops.hop_rms_stream(
        event_stream(t), "user_id", "ts", "value", "12 hours", "6 hours", "1 hour"
    )
    return hops.run_available(stream, folder(t, "rms")).select(
        "user_id", F.unix_micros("window_start").alias("window_start"),
        F.round("rms", 6).alias("rms"),
    )


@query(
    "hop_rms_flushed",
    f"""SELECT user_id, CAST((epoch_us(ts) // {v.HOP} - k) * {v.HOP} AS BIGINT) AS window_start,
               round(sqrt(avg(round(value * 100, 0) * round(value * 100, 0))), 6) AS rms
        FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2""",
)
def hop_rms_flushed(t):
    """All windows of the table: closed ones from the stream, open ones from its state."""
    stream = hops.hop_rms_stream(
        event_stream(t), "user_id", "ts", "value", "12 hours", "6 hours", "1 hour"
    )
    return hops.hop_rms_to_end(stream, folder(t, "rms"), "user_id").select(
        "user_id", F.unix_micros("window_start").alias("window_start"),
        F.round("rms", 6).alias("rms"),
    )


@query(
    "smooth_stream",
    f"""WITH RECURSIVE e AS (
          SELECT user_id, epoch_us(ts) AS at_us, round(value * 100, 0) AS x,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
        s AS (SELECT user_id, at_us, k, x AS value FROM e WHERE k = 1
              UNION ALL
              SELECT e.user_id, e.at_us, e.k, e.x + (s.value - e.x)
                     * exp(-1.0::DOUBLE / CASE WHEN e.x > s.value THEN {ATTACK} ELSE {RELEASE} END)
              FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
        SELECT user_id, at_us, round(value, 6) AS value FROM s""",
)
def smooth_stream(t):
    rows = event_stream(t).select("user_id", F.unix_micros("ts").alias("at_us"), "value")
    stream = hops.smooth_stream(rows, "user_id", "at_us", "value", 1.0, ATTACK, RELEASE)
    return hops.run_available(stream, folder(t, "smooth")).withColumn(
        "value", F.round("value", 6)
    )
