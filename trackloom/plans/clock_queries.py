"""Time algebra on the event clock and on text and lineitem numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import clock
from trackloom.plans import views as v
from trackloom.plans.registry import query

PER_FRAME = v.RATE * v.FPS_DEN // v.FPS_NUM


def frames(t):
    """Every hourly frame of every user's 30 days."""
    ranges = v.tracks(t).withColumn("start_sample", v.long(0)).withColumnRenamed(
        "duration_samples", "end_sample"
    )
    return clock.frame_grid(ranges, v.RATE, v.FPS_NUM, v.FPS_DEN).select(
        "track_id", "frame", "sample"
    )


GRID = f"""grid AS (
  SELECT track_id, frame, frame * {PER_FRAME} AS sample
  FROM (SELECT DISTINCT user_id AS track_id FROM events),
       (SELECT CAST(unnest(range({v.DURATION // PER_FRAME})) AS BIGINT) AS frame))"""


@query(
    "sample_at_frame",
    """SELECT o_orderkey, CAST(frame * 48000 * 1001 // 30000 AS BIGINT) AS sample
       FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS frame FROM orders)""",
)
def sample_at_frame(t):
    frame = F.floor("o_totalprice").cast("long")
    return t.orders.select(
        "o_orderkey", clock.sample_at_frame(frame, 48_000, 30_000, 1_001).alias("sample")
    )


@query(
    "sample_at_frame_overflow",
    """SELECT o_orderkey,
              CASE WHEN f * 48000 * 1001 // 30000 <= 9007199254740991
                   THEN CAST(f * 48000 * 1001 // 30000 AS BIGINT) END AS sample
       FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS HUGEINT) * 20000000 AS f FROM orders)""",
)
def sample_at_frame_overflow(t):
    frame = F.floor("o_totalprice").cast("long") * 20_000_000
    return t.orders.select(
        "o_orderkey", clock.sample_at_frame(frame, 48_000, 30_000, 1_001).alias("sample")
    )


@query(
    "first_frame_at_sample",
    f"""WITH {v.EV}
        SELECT event_id, (sample + {PER_FRAME - 1}) // {PER_FRAME} AS hour_frame,
               CAST((CAST(sample AS HUGEINT) * 30000 + 1000000 * 1001 - 1) // (1000000 * 1001)
                    AS BIGINT) AS video_frame
        FROM ev""",
)
def first_frame_at_sample(t):
    return v.events(t).select(
        "event_id",
        clock.first_frame_at_sample("sample", v.RATE, v.FPS_NUM, v.FPS_DEN).alias("hour_frame"),
        clock.first_frame_at_sample("sample", v.RATE, 30_000, 1_001).alias("video_frame"),
    )


@query(
    "frame_count",
    f"""WITH {v.EV}, {v.SEC}
        SELECT section_id, (end_sample - start_sample + {PER_FRAME - 1}) // {PER_FRAME} AS frames
        FROM sec""",
)
def frame_count(t):
    return v.sections(t).select(
        "section_id",
        clock.frame_count(
            F.col("end_sample") - F.col("start_sample"), v.RATE, v.FPS_NUM, v.FPS_DEN
        ).alias("frames"),
    )


@query(
    "frame_grid",
    f"""WITH {v.EV}, {v.SEC}
        SELECT section_id, CAST(frame AS BIGINT) AS frame, CAST(frame * {PER_FRAME} AS BIGINT) AS sample
        FROM (SELECT section_id, unnest(range((start_sample + {PER_FRAME - 1}) // {PER_FRAME},
                                              (end_sample + {PER_FRAME - 1}) // {PER_FRAME})) AS frame
              FROM sec)""",
)
def frame_grid(t):
    return clock.frame_grid(v.sections(t), v.RATE, v.FPS_NUM, v.FPS_DEN).select(
        "section_id", "frame", "sample"
    )


@query(
    "frame_context",
    f"""WITH {GRID}
        SELECT track_id, frame, sample, round(frame * 3600.0::DOUBLE, 6) AS seconds,
               3600.0::DOUBLE AS delta_seconds
        FROM grid""",
)
def frame_context(t):
    return frames(t).select(
        "track_id",
        "frame",
        "sample",
        F.round(clock.frame_seconds("frame", v.FPS_NUM, v.FPS_DEN), 6).alias("seconds"),
        clock.delta_seconds(v.FPS_NUM, v.FPS_DEN).alias("delta_seconds"),
    )


@query(
    "frame_alignment",
    """SELECT conv_id, turn, start_sample % 1600 = 0 AS start_aligned,
              end_sample % 1600 = 0 AS end_aligned
       FROM (SELECT conv_id, turn, turn * 96000 AS start_sample,
                    turn * 96000 + length(text) * 100 AS end_sample FROM conversations)""",
)
def frame_alignment(t):
    start = F.col("turn") * 96_000
    return t.conversations.select(
        "conv_id",
        "turn",
        clock.is_frame_aligned(start, 48_000, 30, 1).alias("start_aligned"),
        clock.is_frame_aligned(start + F.length("text") * 100, 48_000, 30, 1).alias("end_aligned"),
    )


@query(
    "parse_rate",
    """SELECT p_partkey, p_size * 1001 // gcd(p_size * 1001, p_partkey % 1200) AS num,
              CAST((p_partkey % 1200) // gcd(p_size * 1001, p_partkey % 1200) AS BIGINT) AS den
       FROM part WHERE p_partkey % 1200 > 0
       UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 1200 = 0""",
)
def parse_rate(t):
    text = F.concat_ws(
        "/",
        (F.col("p_size") * 1001).cast("string"),
        (F.col("p_partkey") % 1200).cast("string"),
    )
    rate = clock.parse_rate(text)
    return t.part.select("p_partkey", rate["num"].alias("num"), rate["den"].alias("den"))


@query(
    "clock_text",
    """SELECT o_orderkey,
              (m * 60 + s) * 48000 + f * 480 AS lrc_sample,
              (((m // 60) * 3600 + (m % 60) * 60 + s) * 1000 + f * 10 + 7) * 48 AS srt_sample
       FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) // 60 AS m,
                    CAST(floor(o_totalprice) AS BIGINT) % 60 AS s, o_orderkey % 100 AS f
             FROM orders)""",
)
def clock_text(t):
    whole = F.floor("o_totalprice").cast("long")
    m, s = F.call_function("div", whole, F.lit(60)), whole % 60
    f = F.format_string("%02d", F.col("o_orderkey") % 100)
    lrc = F.concat(F.format_string("%02d:%02d", m, s), F.lit("."), f)
    srt = F.concat(
        F.format_string("%02d:%02d:%02d", F.call_function("div", m, F.lit(60)), m % 60, s),
        F.lit(","), f, F.lit("7"),
    )
    lrc_part = lambda i: F.regexp_extract("lrc", r"(\d+):(\d{2})\.(\d+)", i)
    srt_part = lambda i: F.regexp_extract("srt", r"(\d+):(\d{2}):(\d{2})[,.](\d{3})", i)
    return t.orders.select("o_orderkey", lrc.alias("lrc"), srt.alias("srt")).select(
        "o_orderkey",
        clock.lrc_samples(lrc_part(1), lrc_part(2), lrc_part(3)).alias("lrc_sample"),
        clock.srt_samples(*[srt_part(i) for i in (1, 2, 3, 4)]).alias("srt_sample"),
    )


@query(
    "seconds_to_range",
    """WITH r AS (
         SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity / 96000 + l_tax AS a,
                l_quantity / 96000 + l_tax + l_discount AS b FROM lineitem)
       SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, epoch_us(l_shipdate) AS ship,
              greatest(0, least(4799, CAST(round_even(a * 48000, 0) AS BIGINT))) AS start_sample,
              greatest(greatest(0, least(4799, CAST(round_even(a * 48000, 0) AS BIGINT))) + 1,
                       least(4800, CAST(round_even(b * 48000, 0) AS BIGINT))) AS end_sample
       FROM r WHERE b > a AND b > 0 AND a * 48000 < 4800""",
)
def seconds_to_range(t):
    a = F.col("l_quantity") / 96_000 + F.col("l_tax")
    b = a + F.col("l_discount")
    return (
        t.lineitem.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ship"),
            clock.seconds_to_range(a, b, v.long(4_800)).alias("r"),
        )
        .where("r is not null")
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "ship", "r.*")
    )


@query(
    "pulse_frames",
    f"""WITH {v.EV}, {v.TR}, p AS (
          SELECT DISTINCT track_id, (sample + {PER_FRAME - 1}) // {PER_FRAME} AS frame
          FROM ev WHERE name = 'purchase')
        SELECT track_id, frame, NULL AS reason FROM p
        UNION ALL
        SELECT track_id, NULL, 'missing_pulse_event' FROM tr
        WHERE track_id NOT IN (SELECT track_id FROM p)""",
)
def pulse_frames(t):
    return clock.pulse_frames(
        v.events(t), "purchase", v.RATE, v.FPS_NUM, v.FPS_DEN, v.tracks(t)
    )
