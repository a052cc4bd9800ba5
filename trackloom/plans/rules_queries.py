"""Data quality rules over all tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import rules as ru
from trackloom.plans import views as v
from trackloom.plans.registry import query
from trackloom.plans.structure_queries import MARKS, marks

KEY = ["track_id"]
EB = v.EVENT_BLOCK


@query(
    "rule_unique_key",
    """SELECT 'unique_key' AS rule, l_orderkey, l_linenumber, CAST(count(*) AS VARCHAR) AS detail
       FROM lineitem GROUP BY 2, 3 HAVING count(*) > 1""",
)
def unique_key(t):
    return ru.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"])


def uncut(t):
    return v.events(t).where("name = 'signup'").select(
        "track_id", F.col("sample").alias("start_sample"),
        (F.col("sample") + v.HALF_DAY).alias("end_sample"),
    )


UNCUT = f"""uncut AS (
  SELECT track_id, sample AS start_sample, sample + {v.HALF_DAY} AS end_sample,
         lag(sample + {v.HALF_DAY}) OVER (PARTITION BY track_id ORDER BY sample) AS before
  FROM ev WHERE name = 'signup')"""


@query(
    "rule_ordered_ranges",
    f"""WITH {v.EV}, {UNCUT}
        SELECT 'overlapping_range' AS rule, track_id, start_sample, CAST(before AS VARCHAR) AS detail
        FROM uncut WHERE before > start_sample""",
)
def ordered_ranges(t):
    return ru.ordered_ranges(uncut(t), KEY, EB)


@query(
    "rule_range_list_order",
    """SELECT 'overlapping_range' AS rule, o_custkey, start_sample, CAST(before AS VARCHAR) AS detail
       FROM (SELECT o_custkey, s AS start_sample,
                    lag(s + o_orderkey % 50 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before
             FROM (SELECT o_custkey, o_orderkey, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s
                   FROM orders))
       WHERE before > start_sample""",
)
def range_list_order(t):
    """Orders of a customer as a list of ranges of days: those out of order overlap the one before."""
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    ranges = t.orders.select(
        "o_custkey", "o_orderkey", start.alias("start_sample"), (start + F.col("o_orderkey") % 50 + 1).alias("end_sample")
    )
    return ru.ordered_ranges(ranges, ["o_custkey"], 4096, "o_orderkey")


@query(
    "rule_contiguous_ranges",
    f"""WITH {v.EV}, {v.SEC}
        SELECT 'gap_or_overlap' AS rule, track_id, start_sample, CAST(b AS VARCHAR) AS detail
        FROM (SELECT *, lag(end_sample) OVER (PARTITION BY track_id ORDER BY start_sample) AS b FROM sec)
        WHERE b <> start_sample""",
)
def contiguous_ranges(t):
    return ru.contiguous_ranges(v.sections(t), KEY, EB)


@query(
    "rule_full_cover",
    f"""WITH {v.EV}, {v.SEC}, {v.TR}
        SELECT 'incomplete_cover' AS rule, tr.track_id,
               coalesce(min(start_sample), -1) || '-' || coalesce(max(end_sample), -1) AS detail
        FROM tr LEFT JOIN sec ON sec.track_id = tr.track_id GROUP BY tr.track_id, duration_samples
        HAVING NOT (coalesce(min(start_sample) = 0, FALSE)
                    AND coalesce(max(end_sample) = duration_samples, FALSE))""",
)
def full_cover(t):
    return ru.full_cover(v.sections(t), v.tracks(t), KEY)


@query(
    "rule_inside_track",
    f"""WITH {v.CUES}
        SELECT 'out_of_track' AS rule, track_id, cue_idx, CAST(end_sample AS VARCHAR) AS detail
        FROM cue WHERE end_sample > 300000""",
)
def inside_track(t):
    tracks = v.cues(t).select("track_id").distinct().withColumn(
        "duration_samples", v.long(300_000)
    )
    return ru.inside_track(v.cues(t), tracks, ["track_id", "cue_idx"])


@query(
    "rule_domain",
    """SELECT 'domain' AS rule, p_partkey, unnest(list_filter([
           CASE WHEN NOT p_size BETWEEN 1 AND 40 THEN 'size' END,
           CASE WHEN NOT regexp_matches(p_name, '^[a-zA-Z0-9_.-]+$') THEN 'name' END,
           CASE WHEN p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'type' END],
           lambda x: x IS NOT NULL)) AS detail FROM part""",
)
def domain(t):
    return ru.domain(
        t.part, ["p_partkey"],
        {
            "size": F.col("p_size").between(1, 40),
            "name": F.col("p_name").rlike(ru.NAME),
            "type": F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO"),
        },
    )


@query(
    "rule_conditional_presence",
    """SELECT 'presence' AS rule, o_orderkey, unnest(list_filter([
           CASE WHEN o_totalprice < 100000 THEN 'output required' END,
           CASE WHEN o_custkey % 3 = 0 THEN 'error forbidden' END], lambda x: x IS NOT NULL)) AS detail
       FROM orders WHERE o_orderstatus = 'F'""",
)
def conditional_presence(t):
    rows = t.orders.select(
        "o_orderkey", "o_orderstatus",
        F.when(F.col("o_totalprice") >= 100_000, "file").alias("output"),
        F.when(F.col("o_custkey") % 3 == 0, "code").alias("error"),
    )
    return ru.conditional_presence(
        rows, ["o_orderkey"], F.col("o_orderstatus") == "F", ["output"], ["error"]
    )


@query(
    "rule_required_keys",
    """SELECT 'key_set' AS rule, l_orderkey, concat_ws(',',
           CASE WHEN NOT bool_or(l_returnflag = 'A') THEN '-A' END,
           CASE WHEN NOT bool_or(l_returnflag = 'N') THEN '-N' END,
           CASE WHEN bool_or(l_returnflag = 'R') THEN '+R' END) AS detail
       FROM lineitem GROUP BY 2
       HAVING NOT (bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'N')
                   AND NOT bool_or(l_returnflag = 'R'))""",
)
def required_keys(t):
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("have"))
    return ru.required_keys(sets, ["l_orderkey"], "have", F.array(F.lit("A"), F.lit("N")))


@query(
    "rule_unknown_reference",
    """SELECT 'unknown_reference' AS rule, l_orderkey, l_suppkey, l_linenumber,
              CAST(ref AS VARCHAR) AS detail
       FROM (SELECT *, l_partkey + l_linenumber AS ref FROM lineitem) l
       WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = ref AND p_size % 3 = l_suppkey % 3)""",
)
def unknown_reference(t):
    rows = t.lineitem.withColumns(
        {"ref": F.col("l_partkey") + F.col("l_linenumber"), "track_id": F.col("l_suppkey") % 3}
    )
    known = t.part.withColumn("track_id", F.col("p_size") % 3)
    return ru.unknown_reference(
        rows, known, ["l_orderkey", "l_suppkey", "l_linenumber"], "ref", "p_partkey"
    )


@query(
    "rule_identity",
    """SELECT 'arithmetic' AS rule, o_orderkey, o_orderkey % 6 || '<>' || coalesce(CAST(n AS VARCHAR), 'null')
                AS detail
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
         ON l_orderkey = o_orderkey WHERE o_orderkey % 6 IS DISTINCT FROM n""",
)
def identity(t):
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("computed")
    )
    rows = t.orders.select("o_orderkey", (F.col("o_orderkey") % 6).alias("declared")).join(
        counts, "o_orderkey", "left"
    )
    return ru.identity(rows, ["o_orderkey"], "declared", "computed")


@query(
    "rule_strictly_increasing",
    f"""WITH {v.EV}
        SELECT 'not_increasing' AS rule, track_id, sample, CAST(CAST(value AS BIGINT) AS VARCHAR) AS detail
        FROM (SELECT *, lag(value) OVER (PARTITION BY track_id ORDER BY sample) AS b FROM ev)
        WHERE b >= value""",
)
def strictly_increasing(t):
    rows = v.events(t).withColumn("value", F.col("value").cast("long"))
    return ru.strictly_increasing(rows, KEY, "sample", "value", EB)


@query(
    "rule_anchored_edges",
    f"""WITH {v.EV}, {v.TR}, {MARKS}
        SELECT 'edge_off_anchor' AS rule, track_id, anchor AS start_anchor,
               CAST(sample + 7 AS VARCHAR) AS detail
        FROM (SELECT *, max(anchor) OVER (PARTITION BY track_id) AS top FROM marks)
        WHERE anchor % 4 = 0 AND anchor < top""",
)
def anchored_edges(t):
    at = t.shared("marks", marks)
    following = at.select(
        "track_id", (F.col("anchor") - 1).alias("anchor"), F.col("sample").alias("end_sample")
    )
    moved = F.col("sample") + F.when(F.col("anchor") % 4 == 0, 7).otherwise(0)
    spans = at.join(following, ["track_id", "anchor"]).select(
        "track_id", F.col("anchor").alias("start_anchor"),
        (F.col("anchor") + 1).alias("end_anchor"), moved.alias("start_sample"), "end_sample",
    )
    return ru.anchored_edges(spans, at, KEY)


def page_files(t):
    """Every page as a stored file with the hash of its content."""
    return t.pages.select(
        "page_id", F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"),
        F.sha2(F.col("html").cast("binary"), 256).alias("sha256"),
    )


def page_refs(t):
    key = F.col("page_id")
    odd = F.concat(F.col("sha256"), F.lit("x"))
    return page_files(t).select(
        "page_id",
        F.when(key % 17 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"),
        F.when(key % 13 == 0, odd).otherwise(F.col("sha256")).alias("sha256"),
    )


@query(
    "rule_content_hash",
    """SELECT 'content_hash' AS rule, page_id,
              CASE WHEN page_id % 17 = 0 THEN 'missing_file' ELSE 'hash_mismatch' END AS detail
       FROM pages WHERE page_id % 17 = 0 OR page_id % 13 = 0""",
)
def content_hash(t):
    return ru.content_hash(page_refs(t), page_files(t), ["page_id"])


@query(
    "rule_path_alias",
    """SELECT 'path_alias' AS rule, split_part(url, '?', 1) AS target, CAST(count(*) AS VARCHAR) AS detail
       FROM (SELECT url FROM pages UNION ALL SELECT url FROM pages WHERE page_id % 4 = 0)
       GROUP BY 2 HAVING count(*) > 1""",
)
def path_alias(t):
    refs = t.pages.select("url").unionByName(t.pages.where("page_id % 4 = 0").select("url"))
    return ru.path_alias(refs, F.substring_index("url", "?", 1))


@query(
    "rule_safe_path",
    """SELECT 'unsafe_path' AS rule, page_id, CASE page_id % 4 WHEN 0 THEN 'remote_path'
              WHEN 1 THEN 'absolute_path' ELSE 'escaping_path' END AS detail
       FROM pages WHERE page_id % 4 < 3""",
)
def safe_path(t):
    key = F.col("page_id") % 4
    name = F.col("page_id").cast("string")
    path = (
        F.when(key == 0, F.col("url"))
        .when(key == 1, F.concat(F.lit("/srv/"), name))
        .when(key == 2, F.concat(F.lit("media/../../"), name))
        .otherwise(F.concat(F.lit("media/..ok/./a/../../"), name))
    )
    return ru.safe_path(t.pages.select("page_id", path.alias("path")), ["page_id"])


@query(
    "rule_closed_profile",
    """SELECT 'unknown_profile' AS rule, p_partkey, CASE p_partkey % 4 WHEN 2 THEN '1280x720x30x1'
              ELSE '1920x1080x60x1' END AS detail FROM part WHERE p_partkey % 4 >= 2""",
)
def closed_profile(t):
    key = F.col("p_partkey") % 4
    pick = lambda *values: F.array(*[F.lit(x) for x in values])[key.cast("int")]
    rows = t.part.select(
        "p_partkey", pick(1920, 1080, 1280, 1920).alias("width"),
        pick(1080, 1920, 720, 1080).alias("height"), pick(30, 30, 30, 60).alias("fps_num"),
        F.lit(1).alias("fps_den"),
    )
    return ru.closed_profile(rows, ["p_partkey"])


@query(
    "rule_constant_rate",
    """SELECT 'frame_off_grid' AS rule, conv_id AS track_id, CAST(turn AS VARCHAR) AS detail
       FROM conversations WHERE conv_id % 5 = 0 AND turn = 1
       UNION ALL
       SELECT DISTINCT 'variable_rate', conv_id, '30000/1000' FROM conversations WHERE conv_id % 7 = 0""",
)
def constant_rate(t):
    conv, turn = F.col("conv_id"), F.col("turn")
    jitter = F.when((conv % 5 == 0) & (turn == 1), 2).when(conv % 3 == 0, 1).otherwise(0)
    stamps = t.conversations.select(
        conv.alias("track_id"), (turn * 3003 + jitter).alias("timestamp")
    )
    probes = t.conversations.select(conv.alias("track_id")).distinct().withColumns(
        {
            "fps_num": F.lit(30_000), "fps_den": F.lit(1_001), "avg_fps_num": F.lit(30_000),
            "avg_fps_den": F.when(F.col("track_id") % 7 == 0, 1_000).otherwise(1_001),
            "tb_num": F.lit(1), "tb_den": F.lit(90_000),
        }
    )
    return ru.constant_rate(stamps, probes, KEY, 3003 * 4)


@query(
    "rule_frame_count",
    """SELECT 'frame_count' AS rule, conv_id AS track_id, CAST(count(*) AS VARCHAR) AS detail
       FROM conversations WHERE conv_id % 11 = 0 GROUP BY 2""",
)
def frame_count(t):
    """Probes of every eleventh conversation declare one frame more than there are timestamps."""
    conv = F.col("conv_id")
    stamps = t.conversations.select(conv.alias("track_id"), (F.col("turn") * 3003).alias("timestamp"))
    probes = t.conversations.groupBy(conv.alias("track_id")).agg(
        (F.count("*") + F.when(F.col("track_id") % 11 == 0, 1).otherwise(0)).alias("frame_count")
    ).withColumns(
        {
            "fps_num": F.lit(30_000), "fps_den": F.lit(1_001), "avg_fps_num": F.lit(30_000),
            "avg_fps_den": F.lit(1_001), "tb_num": F.lit(1), "tb_den": F.lit(90_000),
        }
    )
    return ru.constant_rate(stamps, probes, KEY, 3003 * 4)


@query(
    "rule_same_identity_set",
    """WITH s AS (SELECT o_custkey, o_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag)
                    AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
       SELECT 'identity_set' AS rule, o_custkey, min(ids) || ' <> ' || max(ids) AS detail
       FROM s GROUP BY 2 HAVING min(ids) <> max(ids)""",
)
def same_identity_set(t):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return ru.same_identity_set(rows, ["o_custkey"], "o_orderkey", "l_returnflag")
