"""Variant comparison and media checks over line items, embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.blocks import int_div, ordinal
from trackloom.operators import compare as cp
from trackloom.plans import views as v
from trackloom.plans.registry import query
from trackloom.plans.rules_queries import uncut

KEY = ["track_id"]
ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_returnflag, l_linestatus"


def clips(t):
    """Lines of an order as the variants of one comparison; two ranges by line number."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
             "l_returnflag", "l_linestatus"]
    rows = t.lineitem.select(F.col("l_orderkey").alias("track_id"), *order)
    return ordinal(rows, KEY, order, int_div("l_linenumber", 4), "_n").select(
        "track_id", (F.col("_n") % 2).alias("range_idx"), int_div("_n", 2).alias("variant_idx"),
        F.col("l_quantity").cast("long").alias("frames"), F.col("l_returnflag").alias("profile"),
        F.when(F.col("l_linestatus") == "F", "f").alias("audio"),
    )


CLIPS = f"""clips AS (
  SELECT track_id, n % 2 AS range_idx, n // 2 AS variant_idx, CAST(l_quantity AS BIGINT) AS frames,
         l_returnflag AS profile, CASE WHEN l_linestatus = 'F' THEN 'f' END AS audio
  FROM (SELECT *, l_orderkey AS track_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS n FROM lineitem))"""


@query(
    "compare_variants",
    f"""WITH {CLIPS}
        SELECT a.track_id, a.range_idx, a.variant_idx, unnest(list_filter([
                 CASE WHEN a.frames IS DISTINCT FROM b.frames THEN 'frames' END,
                 CASE WHEN a.profile IS DISTINCT FROM b.profile THEN 'profile' END,
                 CASE WHEN a.audio IS DISTINCT FROM b.audio THEN 'audio' END],
                 lambda x: x IS NOT NULL)) AS field
        FROM clips a JOIN clips b ON b.track_id = a.track_id AND b.range_idx = a.range_idx
          AND b.variant_idx = 0""",
)
def compare_variants(t):
    return cp.compare_variants(clips(t), KEY, ["frames", "profile", "audio"])


@query(
    "eligible_manifests",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'incomplete'
         WHEN o_custkey % 10 = 0 THEN 'source_missing' WHEN o_custkey % 7 = 0 THEN 'inputs_missing'
         WHEN coalesce(n, 0) - o_orderkey % 4 NOT IN (0, 1) THEN 'outputs_invalid' END AS reason
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
         ON l_orderkey = o_orderkey""",
)
def eligible_manifests(t):
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n")
    )
    entry = lambda k: (F.lit(k), F.lit("x"))
    full = F.create_map(*entry("preview_request"), *entry("preview_adapter"))
    rows = t.orders.join(counts, "o_orderkey", "left").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"),
        F.when(F.col("o_custkey") % 10 != 0, "hash").alias("audio_sha256"),
        F.when(F.col("o_custkey") % 7 == 0, F.create_map(*entry("preview_request")))
        .otherwise(full).alias("inputs"),
        F.coalesce("n", v.long(0)).alias("outputs"), (F.col("o_orderkey") % 4).alias("ranges"),
    )
    return cp.eligible(rows, ["preview_request", "preview_adapter"]).select("o_orderkey", "reason")


@query(
    "reel_order",
    f"""WITH {CLIPS}
        SELECT track_id, range_idx, variant_idx, frames,
               row_number() OVER (PARTITION BY track_id ORDER BY range_idx, variant_idx) - 1 AS position,
               CAST(sum(frames) OVER (PARTITION BY track_id) AS BIGINT) AS reel_frames
        FROM clips""",
)
def reel_order(t):
    return cp.reel_order(clips(t), KEY).drop("profile", "audio")


@query(
    "midpoints",
    """SELECT p_partkey, p_size // 2 AS midpoint,
              CASE WHEN w >= h THEN 480 ELSE greatest(1, CAST(round_even(480.0::DOUBLE * w / h, 0) AS BIGINT))
              END AS width,
              CASE WHEN w >= h THEN greatest(1, CAST(round_even(480.0::DOUBLE * h / w, 0) AS BIGINT))
              ELSE 480 END AS height
       FROM (SELECT *, p_size * 16 AS w, p_partkey % 1000 + 1 AS h FROM part)""",
)
def midpoints(t):
    size = cp.thumbnail_size(F.col("p_size") * 16, F.col("p_partkey") % 1000 + 1)
    return t.part.select(
        "p_partkey", cp.midpoint_frame(F.col("p_size")).alias("midpoint"),
        size["width"].alias("width"), size["height"].alias("height"),
    )


@query(
    "signature",
    """SELECT p_partkey, sha256('5:brand' || length(p_brand) || ':' || p_brand || '4:size' || length(p_size::VARCHAR) || ':' || p_size
               || '4:type' || length(p_type) || ':' || p_type) AS signature
       FROM part""",
)
def signature(t):
    facts = F.create_map(
        F.lit("type"), "p_type", F.lit("index"), F.col("p_partkey").cast("string"),
        F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), "p_brand",
    )
    return t.part.withColumn("facts", facts).select(
        "p_partkey", cp.signature("facts", ["index", "codec_type", "nb_read_frames"]).alias("signature")
    )


@query(
    "bundle_parts",
    f"""WITH {v.EV}, s AS (
          SELECT *, sample AS start_sample, sample + {v.HALF_DAY} AS end_sample, value > 4000 AS loud,
                 row_number() OVER w AS n, lag(sample + {v.HALF_DAY}) OVER w AS before,
                 first_value(value > 4000) OVER w AS first
          FROM ev WHERE name = 'signup' WINDOW w AS (PARTITION BY track_id ORDER BY sample))
        SELECT track_id, printf('provider-%02d', n) AS part_id, start_sample, end_sample,
               CASE WHEN loud <> first THEN 'identity_mismatch'
                    WHEN start_sample < before THEN 'overlapping_part' END AS reason FROM s""",
)
def bundle_parts(t):
    parts = v.events(t).where("name = 'signup'").select(
        "track_id", F.col("sample").alias("start_sample"),
        (F.col("sample") + v.HALF_DAY).alias("end_sample"), (F.col("value") > 4000).alias("loud"),
    )
    return cp.bundle(parts, KEY, ["loud"], v.EVENT_BLOCK)


@query(
    "diff_metrics",
    """WITH p AS (
         SELECT a.vec_id, unnest(range(1, 65)) AS k, CAST(a.embedding AS DOUBLE[]) AS x,
                CAST(b.embedding AS DOUBLE[]) AS y
         FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
       SELECT vec_id, round(avg(abs(x[k] - y[k])), 6) AS mean_abs, round(max(abs(x[k] - y[k])), 6) AS max_abs,
              count(*) FILTER (x[k] <> y[k]) AS changed,
              round(10 * log10(1 / avg((x[k] - y[k]) ** 2)), 6) AS psnr_db,
              avg(abs(x[k] - y[k])) <= 0.14 AND max(abs(x[k] - y[k])) <= 0.5 AS passed
       FROM p GROUP BY 1""",
)
def diff_metrics(t):
    wide = F.transform("embedding", lambda x: x.cast("double"))
    a = t.embeddings.select("vec_id", wide.alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), wide.alias("b"))
    out = cp.diff_metrics(a.join(b, "vec_id"), ["vec_id"], "a", "b", 1.0)
    gate = cp.difference_gate(F.col("mean_abs"), F.col("max_abs"), 0.14, 0.5)
    return out.withColumn("passed", gate).withColumns(
        {n: F.round(n, 6) for n in ("mean_abs", "max_abs", "psnr_db")}
    )


@query(
    "spikes",
    f"""WITH {v.EV}, {v.SIG}
        SELECT track_id, idx, value FROM (
          SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS n FROM sig
          WINDOW w AS (PARTITION BY track_id ORDER BY idx)) WHERE value > p + 5000 AND value > n + 5000""",
)
def spikes(t):
    return cp.spikes(v.signals(t).select("track_id", "idx", "value"), KEY, 5000.0, v.HOP_BLOCK)


@query(
    "sync_error",
    f"""WITH {v.EV}, {v.SIG}
        SELECT e.event_id, arg_max(s.idx, (s.value, -s.idx)) - any_value(e.sample // {v.HOP}) AS offset_hops
        FROM ev e JOIN sig s ON s.track_id = e.track_id
          AND s.idx BETWEEN e.sample // {v.HOP} - 3 AND e.sample // {v.HOP} + 3 GROUP BY 1""",
)
def sync_error(t):
    points = v.events(t).select("event_id", "track_id", "sample")
    return cp.sync_error(points, v.signals(t), KEY, ["event_id"], v.HOP, 3)


@query(
    "union_length",
    f"""WITH {v.EV}, s AS (
          SELECT track_id, sample AS a, sample + {v.HALF_DAY} AS b FROM ev WHERE name = 'signup'),
        m AS (SELECT *, max(b) OVER (PARTITION BY track_id ORDER BY a
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s)
        SELECT track_id, CAST(sum(greatest(0, b - greatest(a, coalesce(seen, a)))) AS BIGINT)
                 AS covered_samples FROM m GROUP BY 1""",
)
def union_length(t):
    return cp.union_length(uncut(t), KEY, v.EVENT_BLOCK)


@query(
    "tail_frames",
    """SELECT o_orderkey, base, n AS part, CASE WHEN base - n IN (0, 1) THEN base - n END AS held_frames,
              CASE WHEN base - n NOT IN (0, 1) THEN 'frame_count_mismatch' END AS reason
       FROM (SELECT o_orderkey, o_orderkey % 6 AS base FROM orders)
       JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def tail_frames(t):
    parts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("part")
    )
    rows = t.orders.select("o_orderkey", (F.col("o_orderkey") % 6).alias("base")).join(
        parts, "o_orderkey"
    )
    return cp.tail_frames(rows, "base", "part")


@query(
    "run_stats",
    """WITH r AS (SELECT l_returnflag AS stage, l_linestatus AS mode,
                         CAST(round(l_extendedprice * 100, 0) AS BIGINT) AS ms FROM lineitem),
       k AS (SELECT *, row_number() OVER (PARTITION BY stage, mode ORDER BY ms) AS i,
                    count(*) OVER (PARTITION BY stage, mode) AS n FROM r)
       SELECT stage, mode, round(avg(ms), 6) AS mean, min(ms) AS shortest, max(ms) AS longest,
              any_value(n) AS count,
              CAST((min(ms) FILTER (i = (n + 1) // 2) + min(ms) FILTER (i = n // 2 + 1)) // 2 AS BIGINT)
                AS median,
              min(ms) FILTER (i = (9 * n + 9) // 10) AS p90
       FROM k GROUP BY 1, 2""",
)
def run_stats(t):
    runs = t.lineitem.select(
        F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("mode"),
        F.round(F.col("l_extendedprice") * 100, 0).cast("long").alias("ms"),
    )
    return cp.run_stats(runs, ["stage", "mode"], "ms", block=1 << 16).withColumn(
        "mean", F.round("mean", 6)
    )
