"""Timeline views over the given tables, in Spark and as SQL with the same columns.

Clock of ``events``: one sample per microsecond from 2024-01-01 UTC, 30 days long,
hop of 6 hours (120 hops), frames of 1 hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.blocks import int_div, neighbour, ordinal, tasks_for
from trackloom.plans.registry import Tables

EPOCH = 1_704_067_200_000_000
RATE = 1_000_000
DURATION = 2_592_000_000_000
HOP = 21_600_000_000
HOPS = 120
HOP_BLOCK = 32
DAY = 86_400_000_000
EVENT_BLOCK = 5 * DAY
FPS_NUM, FPS_DEN = 1, 3600
HALF_DAY = 43_200_000_000



def long(value: int):
    return F.lit(value).cast("long")


def tracks(t: Tables) -> DataFrame:
    return (
        t.events.select(F.col("user_id").alias("track_id"))
        .distinct()
        .withColumn("sample_rate", F.lit(RATE))
        .withColumn("duration_samples", F.lit(long(DURATION)))
    )


def events(t: Tables) -> DataFrame:
    """Values in whole hundredths: their sums are exact in any order."""
    return t.events.select(
        "event_id",
        F.col("user_id").alias("track_id"),
        F.col("event_type").alias("name"),
        F.lit("app").alias("source"),
        (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH).alias("sample"),
        F.round(F.col("value") * 100, 0).alias("value"),
        (F.col("value") / (1 + F.col("value"))).alias("confidence"),
    )


EV = f"""ev AS (
  SELECT event_id, user_id AS track_id, event_type AS name, 'app' AS source,
         epoch_us(ts) - {EPOCH} AS sample, round(value * 100, 0) AS value,
         value / (1 + value) AS confidence
  FROM events)"""

TR = f"""tr AS (
  SELECT DISTINCT user_id AS track_id, {RATE} AS sample_rate,
         CAST({DURATION} AS BIGINT) AS duration_samples FROM events)"""


def hop_grid(t: Tables) -> DataFrame:
    return (
        t.events.select(F.col("user_id").alias("track_id"))
        .distinct()
        .withColumn("idx", F.explode(F.sequence(long(0), long(HOPS - 1))))
    )


def signals(t: Tables) -> DataFrame:
    """Sum of ``value`` per user and hop, zero-filled."""
    sums = (
        events(t).groupBy("track_id", int_div("sample", HOP).alias("idx")).agg(
            F.sum("value").alias("value")
        )
    )
    return hop_grid(t).join(sums, ["track_id", "idx"], "left").select(
        "track_id",
        F.lit("activity").alias("name"),
        "idx",
        (F.col("idx") * HOP).alias("sample"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )


SIG = f"""hops AS (
  SELECT track_id, idx FROM (SELECT DISTINCT user_id AS track_id FROM events),
         (SELECT CAST(unnest(range({HOPS})) AS BIGINT) AS idx)),
hop_sums AS (
  SELECT track_id, sample // {HOP} AS idx, sum(value) AS value FROM ev GROUP BY 1, 2),
sig AS (
  SELECT h.track_id, 'activity' AS name, h.idx, h.idx * {HOP} AS sample,
         coalesce(s.value, 0.0) AS value
  FROM hops h LEFT JOIN hop_sums s ON h.track_id = s.track_id AND h.idx = s.idx)"""


BAND_NAMES = ("click", "error", "purchase", "signup", "view")


def band_sums(t: Tables) -> DataFrame:
    return events(t).groupBy("track_id", "name", int_div("sample", HOP).alias("idx")).agg(
        F.sum("value").alias("value")
    )


def band_signals(t: Tables) -> DataFrame:
    """One signal per event type: the bands of the onset envelope.

    Whatever its events, a track has one row per hop and band. So its sums travel together and the
    zeros are made where they are added: the grid is not moved, nor is what is computed of a track.
    """
    sums = t.shared("band_sums", band_sums)
    tracks = sums.select("track_id").distinct().count()
    dealt = sums.repartition(tasks_for(tracks * HOPS * len(BAND_NAMES), t.spark), "track_id")
    hops = F.sequence(long(0), long(HOPS - 1))
    cell = lambda name, idx, value: F.struct(name.alias("name"), idx.alias("idx"), value.alias("value"))
    zeros = F.flatten(
        F.transform(
            F.array(*[F.lit(n) for n in BAND_NAMES]),
            lambda n: F.transform(hops, lambda i: cell(n, i, F.lit(0.0))),
        )
    )
    on_grid = (
        F.col("track_id").isNotNull() & F.col("name").isin(*BAND_NAMES) & F.col("idx").between(0, HOPS - 1)
    )
    own = F.collect_list(F.when(on_grid, cell(F.col("name"), F.col("idx"), F.col("value"))))
    return (
        dealt.groupBy("track_id").agg(own.alias("_own"))
        .select("track_id", F.inline(F.concat("_own", zeros)))
        .groupBy("track_id", "idx", "name").agg(F.sum("value").alias("value"))
    )


BANDS = f"""hops AS (
  SELECT track_id, idx FROM (SELECT DISTINCT user_id AS track_id FROM events),
         (SELECT CAST(unnest(range({HOPS})) AS BIGINT) AS idx)),
band_sums AS (
  SELECT track_id, name, sample // {HOP} AS idx, sum(value) AS value FROM ev GROUP BY 1, 2, 3),
bands AS (
  SELECT h.track_id, n.name, h.idx, coalesce(s.value, 0.0) AS value
  FROM hops h CROSS JOIN (SELECT DISTINCT event_type AS name FROM events) n
  LEFT JOIN band_sums s ON h.track_id = s.track_id AND h.idx = s.idx AND n.name = s.name)"""


def beats(t: Tables) -> DataFrame:
    """Purchases as the beat events of a user."""
    return events(t).where("name = 'purchase'").select("track_id", "sample")


def sections(t: Tables) -> DataFrame:
    """Each signup opens a section of at most 12 hours, cut at the next signup."""
    signups = events(t).where("name = 'signup'").select("track_id", "event_id", "sample")
    following = neighbour(
        signups, ["track_id"], ["sample"], int_div("sample", EVENT_BLOCK), ["sample"], "next", 1
    )
    end = F.least(
        F.col("sample") + HALF_DAY,
        F.coalesce(F.col("next.sample"), long(DURATION)),
        long(DURATION),
    )
    return following.select(
        "track_id",
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("section_id"),
        F.col("sample").alias("start_sample"),
        end.alias("end_sample"),
    )


SEC = f"""sec AS (
  SELECT track_id, 's' || event_id AS section_id, sample AS start_sample,
         least(sample + {HALF_DAY}, coalesce(lead(sample) OVER w, {DURATION}), {DURATION})
           AS end_sample
  FROM ev WHERE name = 'signup' WINDOW w AS (PARTITION BY track_id ORDER BY sample))"""

CUE_GAP, CUE_PER_CHAR = 96_000, 1_600
CUE_BLOCK = CUE_GAP * 64


def cues(t: Tables) -> DataFrame:
    """Conversation turns as cues on a 48 kHz clock."""
    start = F.col("turn") * CUE_GAP
    return t.conversations.select(
        F.col("conv_id").alias("track_id"),
        F.col("turn").alias("cue_idx"),
        start.alias("start_sample"),
        (start + F.least(F.lit(CUE_GAP), F.length("text") * CUE_PER_CHAR)).alias("end_sample"),
        "text",
    )


CUES = f"""cue AS (
  SELECT conv_id AS track_id, turn AS cue_idx, turn * {CUE_GAP} AS start_sample,
         turn * {CUE_GAP} + least({CUE_GAP}, length(text) * {CUE_PER_CHAR}) AS end_sample, text
  FROM conversations)"""


VEC_BLOCK = 256


def vectors(t: Tables) -> DataFrame:
    """Embeddings as one sequence per label: ``pos`` counts the vectors of a label."""
    rows = t.embeddings.select(F.col("label").cast("long").alias("track_id"), "vec_id", "embedding")
    return ordinal(rows, ["track_id"], ["vec_id"], int_div("vec_id", VEC_BLOCK), "pos")


VEC = """vec AS (
  SELECT CAST(label AS BIGINT) AS track_id, vec_id, embedding,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos
  FROM embeddings)"""

PCM_HOP = 64


def pcm(t: Tables) -> DataFrame:
    """Embeddings laid end to end as 64 samples each: a raw sample stream per label."""
    return vectors(t).select(
        "track_id", "pos", F.posexplode("embedding").alias("j", "x")
    ).select(
        "track_id",
        (F.col("pos") * PCM_HOP + F.col("j")).alias("sample"),
        F.col("x").cast("double").alias("value"),
    )


PCM = f"""pcm AS (
  SELECT track_id, pos * {PCM_HOP} + j AS sample, CAST(embedding[j + 1] AS DOUBLE) AS value
  FROM (SELECT track_id, pos, embedding,
               CAST(unnest(range({PCM_HOP})) AS BIGINT) AS j FROM vec))"""

CELL_SAMPLES = 48_000


def cells(t: Tables) -> DataFrame:
    """Vectors of a label as cells A B A: of every 16, the first 8 are played again at the end.

    All vectors are used and the replay plants repeats of known length.
    """
    v = vectors(t)
    part, slot = int_div("pos", 16), F.pmod(F.col("pos"), F.lit(16))
    total = v.groupBy("track_id").agg(F.count("*").alias("_n"))
    rows = v.join(total, "track_id").withColumn("_len", F.least(F.lit(16), F.col("_n") - part * 16))
    first = part * 24 + slot
    again = part * 24 + F.col("_len") + slot
    out = rows.withColumn(
        "cell", F.explode(F.when(slot < 8, F.array(first, again)).otherwise(F.array(first)))
    )
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return out.select(
        "track_id", "cell", vec.alias("vector"), F.abs(vec[0]).alias("energy")
    )


CELLS = """cells AS (
  SELECT track_id, cell, CAST(embedding AS DOUBLE[]) AS vector,
         abs(CAST(embedding[1] AS DOUBLE)) AS energy
  FROM (
    SELECT track_id, embedding,
           unnest(CASE WHEN pos % 16 < 8
                  THEN [pos // 16 * 24 + pos % 16, pos // 16 * 24 + len16 + pos % 16]
                  ELSE [pos // 16 * 24 + pos % 16] END) AS cell
    FROM (SELECT *, least(16, count(*) OVER (PARTITION BY track_id) - pos // 16 * 16) AS len16
          FROM vec)))"""
