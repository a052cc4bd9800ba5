"""Signal features over the event and embedding streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.blocks import int_div
from trackloom.operators import signals as sg
from trackloom.plans import views as v
from trackloom.plans.registry import query

KEY = ["track_id"]
B = v.HOP_BLOCK
FRAME = 2 * v.PCM_HOP
PCM_RATE = 6_400.0  # 50 Hz per bin of a 128-sample frame
LAGS = range(4, 25)
PRE_MAX, POST_MAX, PRE_AVG, POST_AVG, DELTA, WAIT = 2, 1, 9, 10, 0.07, 2


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "frame_hops",
    f"""WITH {v.EV}, {v.SIG}, f AS (
          SELECT track_id, idx // 7 AS hop, value FROM sig)
        SELECT track_id, hop AS idx, round(sum(value), 6) AS total,
               round(sum(value * value), 6) AS energy, count(*) AS samples
        FROM f GROUP BY 1, 2""",
)
def frame_hops(t):
    samples = v.signals(t).select("track_id", F.col("idx").alias("sample"), "value")
    lengths = v.tracks(t).select("track_id", v.long(v.HOPS).alias("duration_samples"))
    return _round(sg.frame_hops(samples, lengths, KEY, 7), "total", "energy")


@query(
    "hop_rms",
    f"""WITH {v.EV}, {v.SIG}
        SELECT track_id, idx, round(sqrt((sq + coalesce(lead(sq) OVER w, 0)) / 8), 6) AS value
        FROM (SELECT track_id, idx // 4 AS idx, sum(value * value) AS sq FROM sig GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY track_id ORDER BY idx)""",
)
def hop_rms(t):
    samples = v.signals(t).select("track_id", F.col("idx").alias("sample"), "value")
    return _round(sg.hop_rms(samples, KEY, 4, 8), "value")


@query(
    "hop_rms_frames",
    f"""WITH {v.EV}, {v.SIG}, s AS (
          SELECT track_id, idx * 11 // 4 AS h, sum(value * value) AS sq FROM sig GROUP BY 1, 2),
        g AS (SELECT DISTINCT track_id, unnest(range(({v.HOPS} * 11 + 3) // 4)) AS idx FROM sig)
        SELECT g.track_id, g.idx, round(sqrt((coalesce(a.sq, 0) + coalesce(b.sq, 0)) / 8), 6) AS value
        FROM g LEFT JOIN s a ON a.track_id = g.track_id AND a.h = g.idx
               LEFT JOIN s b ON b.track_id = g.track_id AND b.h = g.idx + 1""",
)
def hop_rms_frames(t):
    """Samples farther apart than a frame: the frames between them are there, as zeros."""
    samples = v.signals(t).select("track_id", (F.col("idx") * 11).alias("sample"), "value")
    lengths = v.tracks(t).select("track_id", v.long(v.HOPS * 11).alias("duration_samples"))
    return _round(sg.hop_rms(samples, KEY, 4, 8, lengths=lengths), "value")


@query(
    "normalize_signals",
    f"""WITH {v.EV}, {v.BANDS}, m AS (
          SELECT track_id, name, max(abs(value)) AS peak FROM bands GROUP BY 1, 2)
        SELECT b.track_id, b.name, b.idx,
               round(CASE WHEN peak <= 1e-12 THEN 0 ELSE value / peak END, 6) AS value
        FROM bands b JOIN m ON b.track_id = m.track_id AND b.name = m.name""",
)
def normalize_signals(t):
    return _round(sg.normalize(t.shared("bands", v.band_signals), ["track_id", "name"]), "value").select(
        "track_id", "name", "idx", "value"
    )


DFT = f"""frames AS (
  SELECT track_id, sample // {v.PCM_HOP} - k AS idx,
         sample - (sample // {v.PCM_HOP} - k) * {v.PCM_HOP} AS n, value
  FROM pcm, (SELECT unnest([0, 1]) AS k) WHERE sample // {v.PCM_HOP} - k >= 0),
tapered AS (
  SELECT track_id, idx, n, value * (0.5 - 0.5 * cos(2 * pi() * n / {FRAME})) AS x FROM frames),
bins AS (
  SELECT track_id, idx, k,
         sum(x * cos(2 * pi() * k * n / {FRAME})) ** 2
         + sum(x * sin(2 * pi() * k * n / {FRAME})) ** 2 AS power
  FROM tapered, (SELECT unnest(range({FRAME // 2 + 1})) AS k) GROUP BY 1, 2, 3)"""


@query(
    "band_energy",
    f"""WITH {v.VEC}, {v.PCM}, {DFT}
        SELECT track_id, idx, round(sqrt(avg(power)), 6) AS value
        FROM bins WHERE k * {PCM_RATE} / {FRAME} <= 200 GROUP BY 1, 2""",
)
def band_energy(t):
    frames = sg.sample_frames(v.pcm(t), KEY, v.PCM_HOP, FRAME)
    return _round(sg.band_energy(frames, KEY, PCM_RATE), "value")


@query(
    "pitch_class_energy",
    f"""WITH {v.VEC}, {v.PCM}, {DFT}, c AS (
          SELECT track_id, idx, power,
                 CAST(round_even(69 + 12 * log2(k * {PCM_RATE} / {FRAME} / 440.0), 0) AS INT) % 12
                   AS pc
          FROM bins WHERE k > 0)
        SELECT i.track_id, i.idx, p.pitch_class, round(coalesce(sum(c.power), 0), 6) AS value
        FROM (SELECT DISTINCT track_id, idx FROM bins) i
        CROSS JOIN (SELECT unnest({list(sg.PITCH_CLASSES)}) AS pitch_class,
                           unnest(range(12)) AS pc) p
        LEFT JOIN c ON c.track_id = i.track_id AND c.idx = i.idx AND c.pc = p.pc
        GROUP BY 1, 2, 3""",
)
def pitch_class_energy(t):
    frames = sg.sample_frames(v.pcm(t), KEY, v.PCM_HOP, FRAME)
    return _round(sg.pitch_class_energy(frames, KEY, PCM_RATE), "value")


ENVELOPE = """env AS (
  SELECT track_id, idx, coalesce(sum(greatest(value - prev, 0)), 0) AS value
  FROM (SELECT *, lag(value) OVER (PARTITION BY track_id, name ORDER BY idx) AS prev FROM bands)
  GROUP BY 1, 2)"""
NORM_ENV = """norm AS (
  SELECT track_id, idx, value / max(value) OVER (PARTITION BY track_id) AS value FROM env)"""
PEAKS = f"""peaks AS (
  SELECT track_id, idx, value FROM (
    SELECT *,
      max(value) OVER (w ROWS BETWEEN {PRE_MAX} PRECEDING AND {POST_MAX - 1} FOLLOWING) AS top,
      avg(value) OVER (w ROWS BETWEEN {PRE_AVG} PRECEDING AND {POST_AVG - 1} FOLLOWING) AS mean
    FROM norm WINDOW w AS (PARTITION BY track_id ORDER BY idx))
  WHERE value = top AND value >= mean + {DELTA} AND value > 0),
lists AS (
  SELECT track_id, list(idx ORDER BY idx) AS p FROM peaks GROUP BY 1),
kept AS (
  SELECT track_id, unnest(list_reduce(
      list_transform(p, lambda x: [x]),
      lambda acc, x: CASE WHEN x[1] > acc[-1] + {WAIT} THEN list_append(acc, x[1]) ELSE acc END)
    ) AS idx FROM lists)"""


def make_envelope(t):
    return sg.onset_envelope(v.band_signals(t), KEY, "name", B)


def envelope(t):
    return t.shared("envelope", make_envelope)


def loudness(t):
    return sg.normalize(envelope(t), KEY)


@query(
    "onset_envelope",
    f"WITH {v.EV}, {v.BANDS}, {ENVELOPE} SELECT track_id, idx, round(value, 6) AS value FROM env",
)
def onset_envelope(t):
    return _round(make_envelope(t), "value")


def onsets(t):
    return sg.detect_onsets(
        t.shared("loudness", loudness), KEY, B, WAIT, pre_max=PRE_MAX, post_max=POST_MAX,
        pre_avg=PRE_AVG, post_avg=POST_AVG, delta=DELTA,
    )


@query(
    "detect_onsets",
    f"WITH {v.EV}, {v.BANDS}, {ENVELOPE}, {NORM_ENV}, {PEAKS} SELECT track_id, idx FROM kept",
)
def detect_onsets(t):
    return onsets(t).select("track_id", "idx")


@query(
    "estimate_beats",
    f"""WITH {v.EV}, {v.BANDS}, {ENVELOPE}, ac AS (
          SELECT a.track_id, CAST(b.idx - a.idx AS BIGINT) AS lag,
                 round(sum(a.value * b.value), 6) AS s
          FROM env a JOIN env b ON a.track_id = b.track_id
            AND b.idx - a.idx BETWEEN {LAGS.start} AND {LAGS.stop - 1} GROUP BY 1, 2),
        best AS (SELECT track_id, lag FROM ac
                 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY s DESC, lag) = 1),
        ph AS (SELECT e.track_id, lag, e.idx % lag AS phase, round(sum(value), 6) AS s
               FROM env e JOIN best b ON e.track_id = b.track_id GROUP BY 1, 2, 3),
        grid AS (SELECT track_id, lag, phase FROM ph
                 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY s DESC, phase) = 1)
        SELECT track_id, lag, phase, CAST(unnest(range(phase, {v.HOPS}, lag)) AS BIGINT) AS idx
        FROM grid""",
)
def estimate_beats(t):
    return sg.estimate_beats(envelope(t), KEY, LAGS, B)


@query(
    "events_from_frames",
    f"""WITH {v.EV}, {v.BANDS}, {ENVELOPE}, {NORM_ENV}, {PEAKS}
        SELECT k.track_id, 'onset' AS name, 'drums' AS source, k.idx * {v.HOP} AS sample,
               round(n.value, 6) AS confidence
        FROM kept k JOIN norm n ON k.track_id = n.track_id AND k.idx = n.idx""",
)
def events_from_frames(t):
    return _round(
        sg.events_from_frames(onsets(t), envelope(t), v.tracks(t), "onset", "drums", v.HOP),
        "confidence",
    )


@query(
    "sample_signal",
    f"""WITH {v.EV}, {v.SIG}, nx AS (
          SELECT *, lead(value) OVER (PARTITION BY track_id ORDER BY idx) AS nxt FROM sig)
        SELECT e.event_id, round(s.value + coalesce(
                 (s.nxt - s.value) * (e.sample::DOUBLE / {v.HOP} - s.idx), 0), 6) AS level
        FROM ev e JOIN nx s ON e.track_id = s.track_id AND s.idx = e.sample // {v.HOP}""",
)
def sample_signal(t):
    out = sg.sample_signal(t.shared("signals", v.signals), v.events(t), KEY, v.HOP, B)
    return _round(out, "level").select("event_id", "level")


@query(
    "diff_novelty",
    f"""WITH {v.EV}, {v.SIG}, d AS (
          SELECT track_id, idx, sample,
                 abs(value - lag(value) OVER (PARTITION BY track_id ORDER BY idx)) AS novelty
          FROM sig), s AS (
          SELECT track_id, avg(novelty) + stddev_pop(novelty) AS threshold FROM d GROUP BY 1)
        SELECT d.track_id, d.sample, round(novelty, 6) AS novelty, round(threshold, 6) AS threshold
        FROM d JOIN s ON d.track_id = s.track_id
        WHERE novelty >= threshold""",
)
def diff_novelty(t):
    out = sg.diff_novelty(v.signals(t), KEY, v.HOP, B).where("novelty >= threshold")
    return _round(out, "novelty", "threshold").select("track_id", "sample", "novelty", "threshold")


def own_clocks(t):
    """Starts and hops that differ by track."""
    k = F.col("track_id")
    return v.tracks(t).select(
        k, (k % 5 * v.HOP + 7).alias("start_sample"), (F.lit(v.HOP).cast("long") * (1 + k % 2)).alias("hop_samples")
    )


CLOCKS = f"""ck AS (
  SELECT DISTINCT track_id, track_id % 5 * {v.HOP} + 7 AS st, {v.HOP} * (1 + track_id % 2) AS hop FROM sig)"""


@query(
    "sample_signal_clocks",
    f"""WITH {v.EV}, {v.SIG}, {CLOCKS}, m AS (SELECT track_id, max(idx) AS last FROM sig GROUP BY 1), e AS (
          SELECT event_id, ev.track_id, greatest(0.0, (sample - st)::DOUBLE / hop::DOUBLE) AS place, last
          FROM ev JOIN ck USING (track_id) JOIN m USING (track_id))
        SELECT event_id, round(a.value + coalesce((b.value - a.value) * (place - a.idx), 0), 6) AS level
        FROM e JOIN sig a ON a.track_id = e.track_id AND a.idx = least(floor(place)::BIGINT, last)
        LEFT JOIN sig b ON b.track_id = e.track_id AND b.idx = least(floor(place)::BIGINT, last) + 1""",
)
def sample_signal_clocks(t):
    out = sg.sample_signal(
        t.shared("signals", v.signals), v.events(t), KEY, v.HOP, B, clocks=own_clocks(t)
    )
    return _round(out, "level").select("event_id", "level")


@query(
    "diff_novelty_clocks",
    f"""WITH {v.EV}, {v.SIG}, {CLOCKS}, d AS (
          SELECT track_id, idx, abs(value - lag(value) OVER (PARTITION BY track_id ORDER BY idx)) AS novelty
          FROM sig), s AS (
          SELECT track_id, avg(novelty) + stddev_pop(novelty) AS threshold FROM d GROUP BY 1)
        SELECT d.track_id, st + idx * hop AS sample, round(novelty, 6) AS novelty
        FROM d JOIN s ON d.track_id = s.track_id JOIN ck ON ck.track_id = d.track_id
        WHERE novelty >= threshold""",
)
def diff_novelty_clocks(t):
    out = sg.diff_novelty(v.signals(t), KEY, v.HOP, B, clocks=own_clocks(t)).where("novelty >= threshold")
    return _round(out, "novelty").select("track_id", "sample", "novelty")


LENGTHS = f"""lens AS (
  SELECT track_id, natural_samples, target_samples, target_samples - natural_samples AS delta_samples
  FROM (SELECT track_id, max(sample) + 1 AS natural_samples,
               (max(sample) + 1) // 1000 * 1000 + (track_id % 3) * 500 AS target_samples
        FROM pcm GROUP BY 1))"""


def lengths(t):
    natural = v.pcm(t).groupBy("track_id").agg((F.max("sample") + 1).alias("natural_samples"))
    target = int_div("natural_samples", 1000) * 1000 + (F.col("track_id") % 3) * 500
    return sg.length_plan(natural.withColumn("target_samples", target))


@query(
    "length_plan",
    f"""WITH {v.VEC}, {v.PCM}, {LENGTHS}
        SELECT *, CASE WHEN delta_samples = 0 THEN 'none' WHEN delta_samples > 0 THEN 'pad'
                       ELSE 'trim' END AS action FROM lens""",
)
def length_plan(t):
    return lengths(t)


@query(
    "align_length",
    f"""WITH {v.VEC}, {v.PCM}, {LENGTHS}
        SELECT p.track_id, p.sample, round(p.value, 6) AS value
        FROM pcm p JOIN lens l ON p.track_id = l.track_id WHERE p.sample < l.target_samples
        UNION ALL
        SELECT track_id, CAST(unnest(range(natural_samples, target_samples)) AS BIGINT), 0
        FROM lens WHERE delta_samples > 0""",
)
def align_length(t):
    return _round(sg.align_length(v.pcm(t), lengths(t), KEY), "value")


@query(
    "recon_snr",
    f"""WITH {v.VEC}, {v.PCM}, s AS (
          SELECT track_id, value, round(value * 0.6, 3) + round(value * 0.4, 3) AS back FROM pcm)
        SELECT track_id, count(*) AS samples,
               round(10 * log10(sum(value * value) / sum((value - back) ** 2)), 6) AS snr_db
        FROM s GROUP BY 1""",
)
def recon_snr(t):
    whole = v.pcm(t)
    parts = whole.withColumn("share", F.explode(F.array(F.lit(0.6), F.lit(0.4)))).select(
        "track_id", "sample", F.round(F.col("value") * F.col("share"), 3).alias("value")
    )
    return _round(sg.recon_snr(parts, whole, KEY), "snr_db")


@query(
    "required_signals",
    f"""WITH have AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'four' ELSE 'none' END AS mode,
               l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey),
        need AS (SELECT 'none' AS mode, unnest(range(1, 14)) AS k
                 UNION ALL SELECT 'four', unnest(range(1, 19))),
        names AS (SELECT unnest(range(1, 19)) AS k,
                  unnest({["mix.rms", *[f"mix.chroma.{c}" for c in sg.PITCH_CLASSES], "drums.rms",
                           "bass.rms", "vocals.rms", "other.rms", "bass.low_energy"]}) AS signal)
        SELECT o.o_orderkey, o.mode, count(*) AS missing, min(signal) AS first_missing
        FROM (SELECT DISTINCT o_orderkey, mode FROM have) o
        JOIN need n ON o.mode = n.mode JOIN names s ON s.k = n.k
        WHERE NOT EXISTS (SELECT 1 FROM have h
                          WHERE h.o_orderkey = o.o_orderkey AND h.l_linenumber * 2 - 1 = n.k)
        GROUP BY 1, 2""",
)
def required_signals(t):
    """Line k of an order delivers the (2k-1)-th signal; the rest is missing."""
    mode = F.when(F.col("o_orderkey") % 2 == 0, "four").otherwise("none")
    have = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_set("l_linenumber").alias("_lines")
    )
    orders = t.orders.select("o_orderkey", mode.alias("mode")).join(have, "o_orderkey", "left")
    need = sg.required_signals(F.lit("four"))
    got = F.transform(
        F.coalesce("_lines", F.array().cast("array<int>")), lambda k: need[(k * 2 - 2).cast("int")]
    )
    missing = F.array_except(sg.required_signals(F.col("mode")), got)
    return orders.select(
        "o_orderkey", "mode", F.size(missing).cast("long").alias("missing"),
        F.array_min(missing).alias("first_missing"),
    ).where("missing > 0")
