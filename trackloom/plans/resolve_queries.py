"""Plan resolution over events, orders, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.blocks import int_div
from trackloom.operators import resolve as rs
from trackloom.operators import signals as sg
from trackloom.plans import views as v
from trackloom.plans.clock_queries import GRID
from trackloom.plans.registry import query

KEY = ["track_id"]
EB = v.EVENT_BLOCK
FRAME_BLOCK = 256
DELTA = 3600.0
FADE = 3 * 3600 * 1_000_000


def spans(t):
    return rs.fill_gaps(t.shared("sections", v.sections), v.tracks(t), KEY, EB)


SPANS = f"""lagged AS (
  SELECT *, coalesce(lag(end_sample) OVER (PARTITION BY track_id ORDER BY start_sample), 0) AS cur
  FROM sec),
span AS (
  SELECT track_id, start_sample, end_sample, section_id FROM sec
  UNION ALL SELECT track_id, cur, start_sample, NULL FROM lagged WHERE cur < start_sample
  UNION ALL
  SELECT tr.track_id, coalesce(m, 0), duration_samples, NULL FROM tr
  LEFT JOIN (SELECT track_id, max(end_sample) AS m FROM sec GROUP BY 1) x ON x.track_id = tr.track_id
  WHERE coalesce(m, 0) < duration_samples)"""


@query("fill_gaps", f"WITH {v.EV}, {v.TR}, {v.SEC}, {SPANS} SELECT * FROM span")
def fill_gaps(t):
    return spans(t)


def text_map(name):
    """Sorted ``k=v`` list of a map column."""
    pairs = F.transform(
        F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.array_join(pairs, ",")


@query(
    "apply_overrides",
    """SELECT d.doc_id, coalesce(l.quality * 0.5::DOUBLE, 1.0::DOUBLE) AS opacity,
              coalesce(l.toxic = 0, TRUE) AS enabled,
              CASE WHEN l.doc_id IS NULL THEN 'lang=' || lang || ',source=' || source
                   ELSE 'lang=' || CASE WHEN l.quality = 1 THEN 'set' ELSE lang END || ',quality='
                        || l.quality || ',source=' || source END AS parameters
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def apply_overrides(t):
    base = t.documents.select(
        "doc_id", F.lit(1.0).alias("opacity"), F.lit(True).alias("enabled"),
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("parameters"),
    )
    quality = F.col("quality").cast("string")
    over = t.labels.select(
        "doc_id", (F.col("quality") * 0.5).alias("opacity"), (F.col("toxic") == 0).alias("enabled"),
        F.when(
            F.col("quality") == 1,
            F.create_map(F.lit("quality"), quality, F.lit("lang"), F.lit("set")),
        ).otherwise(F.create_map(F.lit("quality"), quality)).alias("parameters"),
    )
    out = rs.apply_overrides(base, over, ["doc_id"], ["opacity", "enabled"])
    return out.withColumn("parameters", text_map("parameters"))


@query(
    "span_layers",
    f"""WITH {v.EV}, {v.TR}, {v.SEC}, {SPANS}, l AS (
          SELECT user_id AS track_id, event_type AS layer_id, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT s.track_id, s.start_sample, s.end_sample, s.section_id, l.layer_id, l.n
        FROM span s JOIN l ON l.track_id = s.track_id""",
)
def span_layers(t):
    layers = v.events(t).groupBy("track_id", F.col("name").alias("layer_id")).agg(
        F.count("*").alias("n")
    )
    return rs.span_layers(layers, spans(t), KEY)


KINDS = (
    "CASE p_partkey % 5 WHEN 0 THEN 'orb' WHEN 1 THEN 'ribbon' WHEN 2 THEN 'particles' "
    "WHEN 3 THEN 'image' ELSE 'video' END"
)


def part_layers(t):
    part_key = F.col("p_partkey")
    key = part_key % 5
    kind = (
        F.when(key == 0, "orb").when(key == 1, "ribbon").when(key == 2, "particles")
        .when(key == 3, "image").otherwise("video")
    )
    text = lambda c: c.cast("string")
    size, price = F.col("p_size"), F.floor("p_retailprice")
    parameters = (
        F.when(key == 0, F.create_map(
            F.lit("radius"), text(size / F.lit(20)), F.lit("color"),
            F.concat(F.lit("#A0"), F.lpad(text(size), F.when(size % 5 == 0, 3).otherwise(4), "0"))))
        .when(key == 1, F.create_map(F.lit("width"), text(size / F.lit(64)), F.lit("price"), text(price)))
        .when(key == 2, F.create_map(
            F.lit("count"), text(F.when(size % 3 == 0, size + 0.5).otherwise(price))))
        .when(key == 3, F.create_map(F.lit("fit"), F.col("p_type"), F.lit("z"), text(size - 25)))
        .when(part_key % 3 == 0, F.create_map(
            F.lit("in_frame"), text(part_key % 40 * 10), F.lit("muted"),
            F.when(part_key % 2 == 0, "false").otherwise("true")))
        .when(part_key % 3 == 1, F.create_map(
            F.lit("out_frame"), text(part_key), F.lit("end_behavior"),
            F.when(part_key % 4 == 0, "bounce").otherwise("hold")))
        .otherwise(F.create_map(F.lit("offset_samples"), text(part_key * 10_000)))
    )
    return t.part.select(
        "p_partkey", kind.alias("kind"), parameters.alias("parameters"),
        (size * 30).cast("long").alias("frame_count"), v.long(1_440_000).alias("duration_samples"),
    )


def _spec_sql():
    rows = [*rs.LAYER_SPECS, *[(kind, *r) for kind in ("image", "video") for r in rs.MEDIA_SPECS]]
    rows += [("video", *r) for r in rs.VIDEO_SPECS]
    lit = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join(
        f"('{k}', '{p}', {lit(d)}, CAST({lit(lo)} AS DOUBLE), CAST({lit(hi)} AS DOUBLE), '{dom}')"
        for k, p, d, lo, hi, dom in rows
    )


@query(
    "resolve_params",
    f"""WITH spec(kind, parameter, fallback, lo, hi, domain) AS (VALUES {_spec_sql()}),
        base AS (SELECT *, {KINDS} AS kind, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part),
        given AS (
          SELECT p_partkey, kind, 'radius' AS parameter, CAST(p_size / 20 AS VARCHAR) AS value
          FROM base WHERE kind = 'orb' UNION ALL
          SELECT p_partkey, kind, 'color',
                 '#A0' || lpad(CAST(p_size AS VARCHAR), CASE WHEN p_size % 5 = 0 THEN 3 ELSE 4 END, '0')
          FROM base WHERE kind = 'orb' UNION ALL
          SELECT p_partkey, kind, 'width', CAST(p_size / 64 AS VARCHAR)
          FROM base WHERE kind = 'ribbon' UNION ALL
          SELECT p_partkey, kind, 'price', CAST(price AS VARCHAR) FROM base WHERE kind = 'ribbon'
          UNION ALL
          SELECT p_partkey, kind, 'count', CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) || '.5'
                 ELSE price || '.0' END FROM base WHERE kind = 'particles' UNION ALL
          SELECT p_partkey, kind, 'fit', p_type FROM base WHERE kind = 'image' UNION ALL
          SELECT p_partkey, kind, 'z', CAST(p_size - 25 AS VARCHAR) FROM base WHERE kind = 'image'
          UNION ALL
          SELECT p_partkey, kind, 'in_frame', CAST(p_partkey % 40 * 10 AS VARCHAR)
          FROM base WHERE kind = 'video' AND p_partkey % 3 = 0 UNION ALL
          SELECT p_partkey, kind, 'muted', CASE WHEN p_partkey % 2 = 0 THEN 'false' ELSE 'true' END
          FROM base WHERE kind = 'video' AND p_partkey % 3 = 0 UNION ALL
          SELECT p_partkey, kind, 'out_frame', CAST(p_partkey AS VARCHAR)
          FROM base WHERE kind = 'video' AND p_partkey % 3 = 1 UNION ALL
          SELECT p_partkey, kind, 'end_behavior', CASE WHEN p_partkey % 4 = 0 THEN 'bounce' ELSE 'hold' END
          FROM base WHERE kind = 'video' AND p_partkey % 3 = 1 UNION ALL
          SELECT p_partkey, kind, 'offset_samples', CAST(p_partkey * 10000 AS VARCHAR)
          FROM base WHERE kind = 'video' AND p_partkey % 3 = 2),
        want AS (
          SELECT b.p_partkey, s.kind, s.parameter, s.domain,
                 CASE WHEN s.parameter = 'out_frame' AND b.p_partkey % 3 = 0 THEN b.p_partkey % 40 * 10 + 1
                      ELSE s.lo END AS lo,
                 CASE s.parameter WHEN 'in_frame' THEN b.p_size * 30 - 1 WHEN 'out_frame' THEN b.p_size * 30
                      WHEN 'offset_samples' THEN 1439999 ELSE s.hi END AS hi,
                 coalesce(g.value, CASE WHEN s.parameter = 'out_frame' THEN CAST(b.p_size * 30 AS VARCHAR)
                                        ELSE s.fallback END) AS value
          FROM base b JOIN spec s ON s.kind = b.kind
          LEFT JOIN given g ON g.p_partkey = b.p_partkey AND g.parameter = s.parameter)
        SELECT p_partkey, kind, parameter,
               CASE WHEN domain = 'color' THEN lower(value) ELSE value END AS value,
               CASE WHEN domain = 'color' AND NOT regexp_matches(value, '^#[0-9a-fA-F]{{6}}$')
                      THEN 'invalid_color'
                    WHEN domain = 'muted' AND value <> 'true' THEN 'media_audio_forbidden'
                    WHEN domain LIKE 'choice:%'
                         AND NOT list_contains(string_split(split_part(domain, ':', 2), '|'), value)
                      THEN 'invalid_choice'
                    WHEN domain = 'number' AND NOT CAST(value AS DOUBLE) BETWEEN lo AND hi
                      THEN 'out_of_range'
                    WHEN domain = 'integer' AND (NOT CAST(value AS DOUBLE) BETWEEN lo AND hi
                         OR CAST(value AS DOUBLE) <> floor(CAST(value AS DOUBLE)))
                      THEN 'out_of_range_or_fraction' END AS reason
        FROM want
        UNION ALL
        SELECT g.p_partkey, g.kind, g.parameter, g.value, 'unknown_layer_parameter'
        FROM given g WHERE NOT EXISTS (
          SELECT 1 FROM spec s WHERE s.kind = g.kind AND s.parameter = g.parameter)""",
)
def resolve_params(t):
    return rs.resolve_params(part_layers(t), rs.spec_table(t.spark), ["p_partkey"])


@query(
    "check_mode",
    """WITH l AS (
         SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'abstract'
                  WHEN '2' THEN 'mood' ELSE 'hybrid' END AS mode,
                CASE l_returnflag WHEN 'A' THEN 'abstract' WHEN 'R' THEN 'media' END AS category,
                l_linestatus = 'F' AS enabled
         FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
       h AS (SELECT o_orderkey, mode,
                    coalesce(bool_or(enabled AND category = 'abstract'), FALSE) AS a,
                    coalesce(bool_or(enabled AND category = 'media'), FALSE) AS m FROM l GROUP BY 1, 2)
       SELECT o_orderkey, mode,
              concat_ws(',', CASE WHEN NOT a AND mode <> 'mood' THEN 'abstract' END,
                        CASE WHEN NOT m AND mode <> 'abstract' THEN 'media' END) AS missing
       FROM h WHERE (NOT a AND mode <> 'mood') OR (NOT m AND mode <> 'abstract')""",
)
def check_mode(t):
    first = F.substring("o_orderpriority", 1, 1)
    mode = F.when(first == "1", "abstract").when(first == "2", "mood").otherwise("hybrid")
    flag = F.col("l_returnflag")
    layers = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", mode.alias("mode"),
        F.when(flag == "A", "abstract").when(flag == "R", "media").alias("category"),
        (F.col("l_linestatus") == "F").alias("enabled"),
    )
    return rs.check_mode(layers, ["o_orderkey"]).withColumn(
        "missing", F.array_join("missing", ",")
    )


@query(
    "resolve_routes",
    """WITH r AS (
         SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'ghost' WHEN p_partkey % 2 = 0 THEN '5-LOW'
                                ELSE '1-URGENT' END AS source,
                CASE WHEN p_partkey % 2 = 0 THEN 'orb' ELSE 'ribbon' END AS kind,
                CASE WHEN p_size % 7 = 0 THEN 'color' ELSE 'y' END AS target,
                p_partkey % 3 AS tf, p_size / 40 AS hi, p_size % 5 = 0 AS extra
         FROM part)
       SELECT p_partkey, CASE WHEN NOT EXISTS (
                  SELECT 1 FROM orders WHERE o_custkey = p_partkey AND o_orderpriority = source)
                THEN 'missing_route_signal'
              WHEN target = 'color' THEN 'unsupported_route_target'
              WHEN extra THEN 'invalid_transform_parameters'
              WHEN hi > 1 THEN 'out_of_bounds' END AS reason
       FROM r""",
)
def resolve_routes(t):
    tf = F.col("p_partkey") % 3
    hi = F.col("p_size") / F.lit(40)
    zero = F.lit(0.0)
    params = (
        F.when(tf == 0, F.create_map(F.lit("min"), zero, F.lit("max"), hi))
        .when(tf == 1, F.create_map(
            F.lit("threshold"), F.lit(0.5), F.lit("low"), zero, F.lit("high"), hi))
        .otherwise(F.create_map(
            F.lit("min"), zero, F.lit("max"), hi, F.lit("attack_seconds"), F.lit(2.0),
            F.lit("release_seconds"), F.lit(5.0)))
    )
    extra = F.when(
        F.col("p_size") % 5 == 0, F.map_concat(params, F.create_map(F.lit("gain"), F.lit(1.0)))
    ).otherwise(params)
    routes = t.part.select(
        "p_partkey", F.col("p_partkey").alias("track_id"),
        F.when(F.col("p_partkey") % 11 == 0, "ghost").when(F.col("p_partkey") % 2 == 0, "5-LOW")
        .otherwise("1-URGENT").alias("source"),
        F.when(F.col("p_partkey") % 2 == 0, "orb").otherwise("ribbon").alias("kind"),
        F.when(F.col("p_size") % 7 == 0, "color").otherwise("y").alias("target_parameter"),
        F.when(tf == 0, "linear").when(tf == 1, "threshold").otherwise("smooth").alias("transform"),
        extra.alias("params"),
    )
    signals = t.orders.select(F.col("o_custkey").alias("track_id"), F.col("o_orderpriority").alias("name"))
    return rs.resolve_routes(routes, signals, rs.spec_table(t.spark), ["p_partkey"])


@query(
    "check_refs",
    """WITH l AS (
         SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey + l_linenumber * 10 AS asset_id,
                l_suppkey % 3 AS track_id,
                CASE WHEN l_returnflag = 'A' THEN 'video' ELSE 'image' END AS kind FROM lineitem),
       a AS (
         SELECT p_partkey, p_partkey % 3 AS track_id, p_size % 2 = 0 AS video FROM part
         UNION ALL SELECT p_partkey, (p_partkey + 1) % 3, p_size % 2 = 1 FROM part)
       SELECT l_orderkey, l_linenumber, l_suppkey, asset_id, kind,
              CASE WHEN video THEN 'video' WHEN NOT video THEN 'image' END AS asset_type,
              CASE WHEN p_partkey IS NULL THEN 'unknown_asset' ELSE 'asset_type_mismatch' END AS reason
       FROM l LEFT JOIN a ON p_partkey = asset_id AND a.track_id = l.track_id
       WHERE p_partkey IS NULL OR video <> (kind = 'video')""",
)
def check_refs(t):
    layers = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        (F.col("l_partkey") + F.col("l_linenumber") * 10).alias("asset_id"),
        (F.col("l_suppkey") % 3).alias("track_id"),
        F.when(F.col("l_returnflag") == "A", "video").otherwise("image").alias("kind"),
    )
    # The same id is a video on one track and an image on the next.
    assets = t.part.select(
        F.col("p_partkey").alias("asset_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "p_size"
    ).select(
        "asset_id", ((F.col("asset_id") + F.col("k")) % 3).alias("track_id"),
        F.when((F.col("p_size") + F.col("k")) % 2 == 0, "video").otherwise("image").alias("type"),
    )
    return rs.check_refs(layers, assets, ["l_orderkey", "l_linenumber", "l_suppkey"])


@query(
    "check_lyrics_refs",
    f"""WITH {v.CUES}, plan AS (
          SELECT DISTINCT track_id, track_id * 3 AS font, 500000 AS d FROM cue)
        SELECT track_id, 'invalid_lyrics_font' AS reason FROM plan
        WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = font AND p_size % 3 = 0
                            AND p_partkey // 3 + p_size // 3 % 2 = track_id)
        UNION ALL
        SELECT c.track_id, 'lyrics_out_of_bounds' FROM cue c JOIN plan p ON p.track_id = c.track_id
        GROUP BY 1 HAVING max(end_sample) > 500000""",
)
def check_lyrics_refs(t):
    cues = v.cues(t)
    plans = cues.select("track_id").distinct().withColumns(
        {"font_asset_id": F.col("track_id") * 3, "duration_samples": v.long(500_000)}
    )
    assets = t.part.select(
        F.col("p_partkey").alias("asset_id"),
        (int_div("p_partkey", 3) + int_div("p_size", 3) % 2).alias("track_id"),
        F.when(F.col("p_size") % 3 == 0, "font").otherwise("image").alias("type"),
    )
    return rs.check_lyrics_refs(plans, assets, cues, KEY)


TRIM = """m AS (
  SELECT p_partkey, CAST(p_size * 30 AS BIGINT) AS frame_count, p_partkey % 40 AS a, p_partkey % 9 AS b,
         p_partkey % 7 AS c
  FROM part),
trim_rows AS (
  SELECT p_partkey, frame_count, CASE WHEN b > 0 THEN a * 10 ELSE 0 END AS in_frame,
         CASE WHEN b > 1 THEN frame_count - b ELSE frame_count END AS out_frame,
         CASE WHEN c > 0 THEN a * 48000 ELSE 0 END AS offset_samples,
         CASE c WHEN 1 THEN 'loop' WHEN 2 THEN 'hold' WHEN 4 THEN 'bounce' ELSE 'error' END AS end_behavior
  FROM m)"""


def trims(t):
    key = F.col("p_partkey")
    a, b, c = key % 40, key % 9, key % 7
    count = (F.col("p_size") * 30).cast("long")
    return t.part.select(
        "p_partkey", count.alias("frame_count"), v.long(30).alias("fps_num"),
        v.long(1).alias("fps_den"), v.long(1_440_000).alias("duration_samples"),
        F.when(b > 0, a * 10).alias("in_frame"),
        F.when(b > 1, count - b).alias("out_frame"),
        F.when(c > 0, a * 48_000).alias("offset_samples"),
        F.when(c == 1, "loop").when(c == 2, "hold").when(c == 3, "error")
        .when(c == 4, "bounce").alias("end_behavior"),
    )


@query(
    "check_trim",
    f"""WITH {TRIM}
        SELECT *, CASE WHEN end_behavior = 'bounce' THEN 'bad_end_behavior'
                 WHEN offset_samples > 1439999 THEN 'bad_offset'
                 WHEN in_frame > frame_count - 1 THEN 'bad_in_frame'
                 WHEN out_frame < in_frame + 1 OR out_frame > frame_count THEN 'bad_out_frame'
                 WHEN end_behavior = 'error'
                      AND (1440000 - offset_samples) * 30 > (out_frame - in_frame) * 48000
                 THEN 'media_too_short' END AS reason
        FROM trim_rows""",
)
def check_trim(t):
    return rs.check_trim(trims(t)).drop("fps_num", "fps_den", "duration_samples")


@query(
    "video_frame",
    f"""WITH {TRIM}, e AS (
          SELECT l_orderkey, l_linenumber, l_suppkey, in_frame, out_frame, end_behavior,
                 in_frame + greatest(0, CAST(l_quantity AS BIGINT) * 48000 - offset_samples) * 30
                   // 48000 AS raw
          FROM lineitem JOIN trim_rows ON p_partkey = l_partkey)
        SELECT l_orderkey, l_linenumber, l_suppkey,
               CASE WHEN raw < out_frame THEN raw WHEN out_frame <= in_frame THEN NULL
                    WHEN end_behavior = 'loop' THEN in_frame + (raw - in_frame) % (out_frame - in_frame)
                    WHEN end_behavior = 'hold' THEN out_frame - 1 END AS frame,
               CASE WHEN raw < out_frame THEN NULL WHEN out_frame <= in_frame THEN 'empty_trim_range'
                    WHEN end_behavior NOT IN ('loop', 'hold') THEN 'media_too_short' END AS reason
        FROM e""",
)
def video_frame(t):
    rows = t.lineitem.join(
        rs.check_trim(trims(t)), F.col("l_partkey") == F.col("p_partkey")
    )
    shown = rs.video_frame(
        F.col("l_quantity").cast("long") * 48_000, v.long(48_000), F.col("fps_num"),
        F.col("fps_den"), F.col("offset_samples"), F.col("in_frame"), F.col("out_frame"),
        F.col("end_behavior"),
    )
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", shown.alias("x")).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "x.frame", "x.reason"
    )


@query(
    "verify_resolved",
    """WITH a AS (SELECT doc_id, lang, CAST(1 AS INT) AS quality FROM documents),
            b AS (SELECT d.doc_id, d.lang, coalesce(l.quality, 1) AS quality
                  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
       SELECT *, 'stored' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
       UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def verify_resolved(t):
    stored = t.documents.select("doc_id", "lang", F.lit(1).alias("quality"))
    fresh = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "lang", F.coalesce("quality", F.lit(1)).alias("quality")
    )
    return rs.verify_resolved(stored, fresh)


def numbered_spans(t):
    """Spans with a fade when they are sections, and an asset, opacity and switch of their own."""
    part = int_div("start_sample", v.HOP) % 5
    return spans(t).withColumns(
        {
            "transition_samples": F.when(F.col("section_id").isNotNull(), FADE).otherwise(0)
            .cast("long"),
            "asset_id": F.concat(F.lit("a"), part.cast("string")),
            "opacity": 1 - part * 0.125,
            "enabled": part != 3,
        }
    )


NUMBERED = f"""num AS (
  SELECT *, CASE WHEN section_id IS NOT NULL THEN {FADE} ELSE 0 END AS transition_samples,
         'a' || (start_sample // {v.HOP} % 5) AS asset_id,
         1 - (start_sample // {v.HOP} % 5) * 0.125::DOUBLE AS opacity,
         start_sample // {v.HOP} % 5 <> 3 AS enabled,
         row_number() OVER (PARTITION BY track_id ORDER BY start_sample) AS k,
         max(start_sample) OVER (PARTITION BY track_id) AS last_start
  FROM span),
owned AS (
  SELECT e.event_id, e.track_id, e.sample, n.start_sample, n.section_id, n.asset_id, n.opacity,
         n.enabled, p.start_sample AS prev_start, p.asset_id AS prev_asset,
         p.opacity AS prev_opacity, p.enabled AS prev_enabled,
         CASE WHEN n.transition_samples > 0
              THEN least(1.0::DOUBLE, (e.sample - n.start_sample)::DOUBLE / n.transition_samples)
              ELSE 1.0::DOUBLE END AS progress
  FROM ev e JOIN num n ON n.track_id = e.track_id AND e.sample >= n.start_sample
                      AND e.sample < n.end_sample
  LEFT JOIN num p ON p.track_id = n.track_id AND p.k = n.k - 1)"""


def owned_events(t):
    points = v.events(t).select("event_id", "track_id", "sample")
    return rs.owner_span(
        points, t.shared("numbered", numbered_spans), KEY, EB, ["section_id", "asset_id", "opacity", "enabled"]
    )


@query(
    "owner_span",
    f"""WITH {v.EV}, {v.TR}, {v.SEC}, {SPANS}, {NUMBERED}
        SELECT event_id, start_sample, section_id, prev_start, round(progress, 6) AS progress
        FROM owned""",
)
def owner_span(t):
    return owned_events(t).select(
        "event_id", "span.start_sample", "span.section_id",
        F.col("previous.start_sample").alias("prev_start"),
        F.round("progress", 6).alias("progress"),
    )


@query(
    "owner_span_fallback",
    f"""WITH {v.EV}, {v.SEC}
        SELECT e.event_id, coalesce(s.section_id, l.last_id) AS section_id
        FROM ev e LEFT JOIN sec s ON s.track_id = e.track_id AND e.sample >= s.start_sample
                                 AND e.sample < s.end_sample
        LEFT JOIN (SELECT track_id, arg_max(section_id, start_sample) AS last_id FROM sec GROUP BY 1) l
          ON l.track_id = e.track_id""",
)
def owner_span_fallback(t):
    points = v.events(t).select("event_id", "track_id", "sample")
    sections = v.sections(t).withColumn("transition_samples", v.long(0))
    return rs.owner_span(points, sections, KEY, EB, ["section_id"]).select(
        "event_id", "span.section_id"
    )


@query(
    "fade_pair",
    f"""WITH {v.EV}, {v.TR}, {v.SEC}, {SPANS}, {NUMBERED}
        SELECT event_id, asset_id AS current_asset,
               CASE WHEN prev_start IS NOT NULL AND progress < 1 THEN prev_asset END AS previous_asset,
               round(opacity * CASE WHEN prev_start IS NOT NULL THEN progress ELSE 1 END
                     * enabled::INT, 6) AS current_opacity,
               CASE WHEN prev_start IS NOT NULL AND progress < 1
                    THEN round(prev_opacity * (1 - progress) * prev_enabled::INT, 6) END
                 AS previous_opacity
        FROM owned""",
)
def fade_pair(t):
    return rs.fade_pair(owned_events(t)).select(
        "event_id", "current_asset", "previous_asset",
        F.round("current_opacity", 6).alias("current_opacity"),
        F.round("previous_opacity", 6).alias("previous_opacity"),
    )


# Hours instead of seconds: the event clock is a thousand times slower than a song.
ROUTES = [
    (0, "activity", "orb", "radius", "linear", {"min": 0.1, "max": 1.2}),
    (1, "activity", "orb", "x", "threshold", {"threshold": 0.5, "low": -0.5, "high": 0.5}),
    (2, "activity", "ribbon", "width", "smooth",
     {"min": 0.05, "max": 0.5, "attack_seconds": 7200.0, "release_seconds": 28800.0}),
    (3, "activity", "orb", "x", "linear", {"min": -0.25, "max": 0.25}),
]


def route_params(k):
    """Parameters of a route: odd tracks drive the radius less."""
    own = F.create_map(*[F.lit(x) for pair in ROUTES[k][5].items() for x in pair])
    if k:
        return own
    less = F.create_map(F.lit("min"), F.lit(0.1), F.lit("max"), F.lit(0.7))
    return F.when(F.col("track_id") % 2 == 0, own).otherwise(less)


def routes(t):
    """Routes of each track; every fifth track has no second route to x."""
    names = ("route_idx", "source", "target_layer", "target_parameter", "transform")
    rows = [
        F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r)], route_params(r[0]).alias("params"))
        for r in ROUTES
    ]
    return (
        v.tracks(t).select("track_id", F.explode(F.array(*rows)).alias("r"))
        .select("track_id", "r.*")
        .where("route_idx <> 3 or track_id % 5 <> 4")
    )


def level_blocks(t):
    """The activity on every frame, in blocks."""
    loud = sg.normalize(t.shared("signals", v.signals), KEY).select("track_id", "idx", "value")
    blocks = sg.sample_grid(
        loud, v.tracks(t), KEY, v.HOP, v.HOP_BLOCK, FRAME_BLOCK, v.RATE, v.FPS_NUM, v.FPS_DEN
    )
    return blocks.withColumn("source", F.lit("activity"))


def levels(t):
    return level_blocks(t).select("track_id", "source", "first_frame", F.posexplode("levels").alias("at", "level")).select(
        "track_id", "source", (F.col("first_frame") + F.col("at")).alias("frame"), "level"
    )


LEVELS = f"""loud AS (
  SELECT track_id, idx, CASE WHEN max(value) OVER (PARTITION BY track_id) <= 1e-12 THEN 0
         ELSE value / max(value) OVER (PARTITION BY track_id) END AS value FROM sig),
nx AS (SELECT *, lead(value) OVER (PARTITION BY track_id ORDER BY idx) AS nxt FROM loud),
lev AS (
  SELECT g.track_id, g.frame, g.sample,
         n.value + coalesce((n.nxt - n.value) * (g.sample::DOUBLE / {v.HOP} - n.idx), 0) AS level
  FROM grid g JOIN nx n ON n.track_id = g.track_id AND n.idx = g.sample // {v.HOP}),
tgt AS (
  SELECT track_id, frame, 0.1 + level * (CASE WHEN track_id % 2 = 0 THEN 1.2 ELSE 0.7 END - 0.1) AS r0,
         CASE WHEN level >= 0.5 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS r1,
         0.05 + level * (0.5 - 0.05) AS r2,
         CASE WHEN track_id % 5 <> 4 THEN -0.25 + level * 0.5 END AS r3 FROM lev)"""
SMOOTH = """sm AS (
  SELECT track_id, frame, r2 AS value FROM tgt WHERE frame = 0
  UNION ALL
  SELECT t.track_id, t.frame, s.value + (t.r2 - s.value)
         * (1 - exp(-3600.0::DOUBLE / CASE WHEN t.r2 > s.value THEN 7200 ELSE 28800 END))
  FROM sm s JOIN tgt t ON t.track_id = s.track_id AND t.frame = s.frame + 1)"""


def routed(t):
    return rs.route_blocks(level_blocks(t), routes(t), KEY, DELTA)


@query(
    "route_target",
    f"""WITH {v.EV}, {v.SIG}, {GRID}, {LEVELS}
        SELECT track_id, frame, round(r0, 6) AS linear, round(r1, 6) AS threshold FROM tgt""",
)
def route_target(t):
    pick = lambda k: rs.route_target(
        F.col("level"), F.lit(ROUTES[k][4]),
        route_params(k),
    )
    return levels(t).select(
        "track_id", "frame", F.round(pick(0), 6).alias("linear"),
        F.round(pick(1), 6).alias("threshold"),
    )


@query(
    "smooth_route",
    f"""WITH RECURSIVE {v.EV}, {v.SIG}, {GRID}, {LEVELS}, {SMOOTH}
        SELECT track_id, 2 AS route_idx, frame, round(value, 6) AS value FROM sm
        UNION ALL SELECT track_id, unnest([0, 1, 3]), frame, round(unnest([r0, r1, r3]), 6) FROM tgt WHERE r3 IS NOT NULL
        UNION ALL SELECT track_id, unnest([0, 1]), frame, round(unnest([r0, r1]), 6) FROM tgt WHERE r3 IS NULL""",
)
def smooth_route(t):
    """All routes of all tracks, the smoothed ones among them."""
    return rs.route_rows(routed(t), KEY).select("track_id", "route_idx", "frame", F.round("value", 6).alias("value"))


@query(
    "dedupe_routes",
    f"""WITH RECURSIVE {v.EV}, {v.SIG}, {GRID}, {LEVELS}, {SMOOTH}
        SELECT track_id, frame, 'orb' AS target_layer, 'radius' AS target_parameter,
               round(r0, 6) AS value FROM tgt
        UNION ALL SELECT track_id, frame, 'orb', 'x', round(coalesce(r3, r1), 6) FROM tgt
        UNION ALL SELECT track_id, frame, 'ribbon', 'width', round(value, 6) FROM sm""",
)
def dedupe_routes(t):
    rows = rs.route_rows(rs.dedupe_blocks(routed(t)), KEY)
    return rows.select("track_id", "frame", "target_layer", "target_parameter", F.round("value", 6).alias("value"))


def layered_spans(t):
    """Each span's layers: orb and ribbon, y and length moved by the span's number."""
    part = int_div("start_sample", v.HOP) % 5
    number = lambda c: c.cast("double")
    orb = F.struct(
        F.lit("orb").alias("layer_id"), number(1 - part * 0.125).alias("opacity"),
        F.lit(True).alias("enabled"),
        F.create_map(
            F.lit("radius"), F.lit(0.34), F.lit("x"), F.lit(-0.48),
            F.lit("y"), number(part * 0.25 - 0.5),
        ).alias("parameters"),
    )
    ribbon = F.struct(
        F.lit("ribbon").alias("layer_id"), F.lit(1.0).alias("opacity"),
        (part != 3).alias("enabled"),
        F.create_map(
            F.lit("width"), F.lit(0.12), F.lit("length"), number(0.5 + part * 0.125),
        ).alias("parameters"),
    )
    return numbered_spans(t).withColumn("layers", F.array(orb, ribbon))


@query(
    "frame_params",
    f"""WITH RECURSIVE {v.EV}, {v.SIG}, {v.TR}, {v.SEC}, {SPANS}, {GRID}, {LEVELS}, {SMOOTH},
        num AS (
          SELECT *, start_sample // {v.HOP} % 5 AS part,
                 CASE WHEN section_id IS NOT NULL THEN {FADE} ELSE 0 END AS tr_samples,
                 lag(start_sample // {v.HOP} % 5) OVER (PARTITION BY track_id ORDER BY start_sample)
                   AS prev FROM span),
        own AS (
          SELECT g.track_id, g.frame, g.sample, n.part, n.prev,
                 CASE WHEN tr_samples > 0
                      THEN least(1.0::DOUBLE, (g.sample - start_sample)::DOUBLE / tr_samples)
                      ELSE 1.0::DOUBLE END AS p
          FROM grid g JOIN num n ON n.track_id = g.track_id AND g.sample >= n.start_sample
                                AND g.sample < n.end_sample),
        f AS (SELECT *, CASE WHEN prev IS NULL THEN 1.0::DOUBLE ELSE p END AS q,
                     coalesce(prev, part) AS b FROM own)
        SELECT f.track_id, f.frame, f.sample, 'orb' AS layer_id, 'radius' AS parameter,
               round(t.r0, 6) AS value, round((1 - b * 0.125) + ((b - part) * 0.125) * q, 6) AS opacity,
               TRUE AS enabled
        FROM f JOIN tgt t ON t.track_id = f.track_id AND t.frame = f.frame
        UNION ALL
        SELECT f.track_id, f.frame, f.sample, 'orb', 'x', round(coalesce(t.r3, t.r1), 6),
               round((1 - b * 0.125) + ((b - part) * 0.125) * q, 6), TRUE
        FROM f JOIN tgt t ON t.track_id = f.track_id AND t.frame = f.frame
        UNION ALL
        SELECT track_id, frame, sample, 'orb', 'y',
               round((b * 0.25 - 0.5) + ((part - b) * 0.25) * q, 6),
               round((1 - b * 0.125) + ((b - part) * 0.125) * q, 6), TRUE FROM f
        UNION ALL
        SELECT f.track_id, f.frame, f.sample, 'ribbon', 'width', round(s.value, 6), 1.0, part <> 3
        FROM f JOIN sm s ON s.track_id = f.track_id AND s.frame = f.frame
        UNION ALL
        SELECT track_id, frame, sample, 'ribbon', 'length',
               round((0.5 + b * 0.125) + ((part - b) * 0.125) * q, 6), 1.0, part <> 3 FROM f""",
)
def frame_params(t):
    out = rs.grid_params(
        t.shared("layered", layered_spans), v.tracks(t), routed(t), KEY, EB, FRAME_BLOCK, v.RATE, v.FPS_NUM, v.FPS_DEN
    )
    return out.withColumns({"value": F.round("value", 6), "opacity": F.round("opacity", 6)})


@query(
    "placement",
    """WITH p AS (
         SELECT p_partkey, p_size / 20 AS asset_aspect, CASE WHEN p_partkey % 2 = 0 THEN 9 / 16
                ELSE 16 / 9 END AS aspect, p_partkey % 2 = 0 AS portrait,
                CASE WHEN p_partkey % 3 = 0 THEN 'contain' ELSE 'cover' END AS fit,
                p_partkey / 10.0::DOUBLE AS seconds FROM part)
       SELECT p_partkey,
         round(CASE WHEN (fit = 'cover') = (asset_aspect >= aspect) THEN asset_aspect ELSE aspect END, 6)
           AS scale_x,
         round(CASE WHEN (fit = 'cover') = (asset_aspect >= aspect) THEN 1 ELSE aspect / asset_aspect
               END, 6) AS scale_y,
         round((0.25 + sin(seconds * 0.2) * 0.1) * aspect, 6) AS x,
         round(-0.5 + cos(seconds * 0.17) * 0.1, 6) AS y,
         round((aspect - aspect * CASE WHEN portrait THEN 0.82 ELSE 0.86 END * 0.97) / (2 * aspect), 6)
           AS box_left,
         round((1 - (CASE WHEN portrait THEN -0.42 ELSE -0.5 END - 0.03)
                - CASE WHEN portrait THEN 0.62 ELSE 0.58 END * 0.97 / 2) / 2, 6) AS box_top,
         round((1 - (CASE WHEN portrait THEN -0.42 ELSE -0.5 END - 0.03)
                + CASE WHEN portrait THEN 0.62 ELSE 0.58 END * 0.97 / 2) / 2, 6) AS box_bottom
       FROM p""",
)
def placement(t):
    portrait = F.col("p_partkey") % 2 == 0
    aspect = F.when(portrait, 9 / 16).otherwise(16 / 9)
    fit = F.when(F.col("p_partkey") % 3 == 0, "contain").otherwise("cover")
    scale = rs.media_scale(aspect, F.col("p_size") / F.lit(20), fit)
    move = rs.media_motion(
        F.lit(0.25), F.lit(-0.5), F.lit(0.1), F.col("p_partkey") / F.lit(10.0), aspect
    )
    box = rs.caption_box(portrait, aspect, F.lit(0.97), F.lit(-0.03))
    r = lambda c, name: F.round(c, 6).alias(name)
    return t.part.select(
        "p_partkey", r(scale["x"], "scale_x"), r(scale["y"], "scale_y"), r(move["x"], "x"),
        r(move["y"], "y"), r(box["left"], "box_left"), r(box["top"], "box_top"),
        r(box["bottom"], "box_bottom"),
    )


@query(
    "max_count",
    """SELECT l_suppkey, l_returnflag AS layer_id,
              max(CASE WHEN l_linenumber = 1 THEN 16 ELSE CAST(l_quantity AS BIGINT) END) AS max_count
       FROM lineitem GROUP BY 1, 2""",
)
def max_count(t):
    rows = t.lineitem.select(
        "l_suppkey", F.col("l_returnflag").alias("layer_id"),
        F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("long")).alias("count"),
    )
    return rs.max_count(rows, ["l_suppkey"])
