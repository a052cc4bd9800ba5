"""Structure mining over events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.blocks import int_div, neighbour
from trackloom.operators import structure as st
from trackloom.plans import views as v
from trackloom.plans.registry import query

KEY = ["track_id"]
CELL = v.CELL_SAMPLES
BLOCK = 40
MARK_BLOCK = 64 * CELL
GAP = v.DAY

MARKS = f"""marks AS (
  SELECT track_id, sample, row_number() OVER (PARTITION BY track_id ORDER BY sample) - 1 AS anchor
  FROM (SELECT track_id, sample FROM ev WHERE name = 'purchase' AND sample > 0
        UNION SELECT track_id, 0 FROM tr UNION SELECT track_id, duration_samples FROM tr))"""


def marks(t):
    return st.anchors(v.beats(t), v.tracks(t), KEY, v.EVENT_BLOCK)


@query("anchors", f"WITH {v.EV}, {v.TR}, {MARKS} SELECT * FROM marks")
def anchors(t):
    return marks(t)


@query(
    "sync_mean",
    f"""WITH {v.EV}, {v.SIG}, {v.TR}, {MARKS}, c AS (
          SELECT track_id, anchor AS cell, sample AS start_sample,
                 lead(sample) OVER (PARTITION BY track_id ORDER BY sample) AS end_sample FROM marks)
        SELECT c.track_id, c.cell, c.start_sample, c.end_sample,
               round(coalesce(avg(s.value), 0), 6) AS value
        FROM c LEFT JOIN sig s ON s.track_id = c.track_id AND s.sample >= c.start_sample
                              AND s.sample < c.end_sample
        WHERE c.end_sample IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def sync_mean(t):
    cells = st.anchor_cells(marks(t), KEY, v.EVENT_BLOCK)
    return st.sync_mean(v.signals(t), cells, KEY, v.EVENT_BLOCK).withColumn(
        "value", F.round("value", 6)
    )


FEAT = f"""{v.VEC}, {v.CELLS}, unit AS (
  SELECT track_id, cell, energy,
         list_append(list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))),
                     energy * 0.5) AS u FROM cells),
feat AS (
  SELECT track_id, cell, energy,
         list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS f FROM unit)"""
SIM = """sim AS (
  SELECT a.track_id, a.cell AS i, b.cell AS j,
         greatest(0, least(1, list_dot_product(a.f, b.f))) AS similarity,
         a.energy > 1e-12 OR b.energy > 1e-12 AS loud
  FROM feat a JOIN feat b ON a.track_id = b.track_id)"""
CEND = f"""ct AS (
  SELECT track_id, count(*) AS cells, count(*) * {CELL} AS duration_samples FROM cells GROUP BY 1),
cm AS (
  SELECT track_id, cell AS anchor, cell * {CELL} AS sample FROM cells
  UNION ALL SELECT track_id, cells, duration_samples FROM ct)"""
NOV = """bw AS (
  SELECT c.track_id, c.cell AS b, c.energy, least(4, c.cell, ct.cells - c.cell) AS w,
         lag(c.energy) OVER (PARTITION BY c.track_id ORDER BY c.cell) AS pe
  FROM cells c JOIN ct ON c.track_id = ct.track_id),
nov AS (
  SELECT bw.track_id, b AS idx,
         CASE WHEN b = 0 THEN 0 ELSE round(greatest(0, least(1, 0.75 * greatest(0,
             (avg(similarity) FILTER (i < b AND j < b) + avg(similarity) FILTER (i >= b AND j >= b))
               / 2 - avg(similarity) FILTER (i < b AND j >= b))
           + 0.25 * abs(any_value(energy) - any_value(pe)))), 9) END AS score
  FROM bw LEFT JOIN sim ON bw.track_id = sim.track_id AND i >= b - w AND i < b + w
                       AND j >= b - w AND j < b + w
  GROUP BY 1, 2),
peaks AS (
  SELECT track_id, idx, score FROM (
    SELECT *, lag(score) OVER w AS p, lead(score) OVER w AS n FROM nov
    WINDOW w AS (PARTITION BY track_id ORDER BY idx))
  WHERE idx > 0 AND score >= 0.12 AND score >= p AND (n IS NULL OR score >= n))"""
CAND = """runs AS (
  SELECT s.track_id, s.i, s.j, s.similarity, s.loud,
         s.i - row_number() OVER (PARTITION BY s.track_id, s.j - s.i ORDER BY s.i) AS island
  FROM sim s WHERE s.j - s.i >= 3 AND s.similarity >= 0.86),
lens AS (
  SELECT r.*, least(16, r.j - r.i, ct.cells - r.j,
                    max(r.i) OVER (PARTITION BY r.track_id, r.j - r.i, island) - r.i + 1) AS length
  FROM runs r JOIN ct ON r.track_id = ct.track_id),
cand AS (
  SELECT l.track_id, l.i AS left_cell, l.j AS right_cell, l.length, round(avg(r.similarity), 9) AS score
  FROM lens l JOIN runs r ON r.track_id = l.track_id AND r.j - r.i = l.j - l.i
    AND r.i >= l.i AND r.i < l.i + l.length
  WHERE l.length >= 3 GROUP BY 1, 2, 3, 4 HAVING bool_or(r.loud))"""
REP = """ranked AS (
  SELECT track_id, list({'l': left_cell, 'r': right_cell, 'n': length, 's': score}
           ORDER BY length DESC, score DESC, left_cell, right_cell) AS c FROM cand GROUP BY 1),
chosen AS (
  SELECT track_id, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda acc, x:
    CASE WHEN len(acc) >= 8 OR len(list_filter(acc, lambda a: a.n = x[1].n AND
           (a.l = x[1].l OR a.l = x[1].r OR a.r = x[1].l OR a.r = x[1].r))) > 0
         THEN acc ELSE list_append(acc, x[1]) END)) AS p FROM ranked),
rep AS (
  SELECT track_id, p.l AS l, p.r AS r, p.n AS n, p.s AS score,
         printf('repeat-%03d', row_number() OVER (PARTITION BY track_id ORDER BY p.l, p.r)) AS group_id
  FROM chosen)"""
SPANS = """spans AS (
  SELECT p.track_id, p.group_id, p.score AS confidence, p.group_id || '-' || k AS span_id,
         CASE k WHEN 1 THEN l ELSE r END AS start_anchor,
         CASE k WHEN 1 THEN l ELSE r END + n AS end_anchor
  FROM rep p, (SELECT unnest([1, 2]) AS k)),
sp AS (
  SELECT s.*, a.sample AS start_sample, b.sample AS end_sample FROM spans s
  JOIN cm a ON a.track_id = s.track_id AND a.anchor = s.start_anchor
  JOIN cm b ON b.track_id = s.track_id AND b.anchor = s.end_anchor)"""
BND = """ev9 AS (
  SELECT p.track_id, m.sample, 'novelty' AS source, p.score AS confidence
  FROM peaks p JOIN cm m ON m.track_id = p.track_id AND m.anchor = p.idx
  UNION ALL
  SELECT s.track_id, s.x, s.group_id, s.confidence
  FROM (SELECT *, unnest([start_sample, end_sample]) AS x FROM sp) s
  JOIN ct ON ct.track_id = s.track_id WHERE s.x > 0 AND s.x < ct.duration_samples),
bnd AS (
  SELECT track_id, sample, max(confidence) AS confidence,
         array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
         row_number() OVER (PARTITION BY track_id ORDER BY sample) AS n,
         printf('boundary-%03d', row_number() OVER (PARTITION BY track_id ORDER BY sample))
           AS boundary_id
  FROM ev9 GROUP BY 1, 2)"""


def cells(t):
    return t.shared("cells", v.cells)


def features(t):
    return st.cell_features(cells(t))


def cell_tracks(t):
    return cells(t).groupBy("track_id").agg(
        F.count("*").alias("cells"), (F.count("*") * CELL).alias("duration_samples")
    )


def cell_marks(t):
    here = cells(t).select(
        "track_id", F.col("cell").alias("anchor"), (F.col("cell") * CELL).alias("sample")
    )
    return here.unionByName(
        cell_tracks(t).select(
            "track_id", F.col("cells").alias("anchor"), F.col("duration_samples").alias("sample")
        )
    )


def candidates(t):
    similar = st.self_similarity(features(t), KEY, tile=BLOCK)
    return st.repeat_candidates(similar, cell_tracks(t), KEY, BLOCK)


def repeats(t):
    return st.select_repeats(t.shared("candidates", candidates), KEY)


def peaks(t):
    return st.pick_peaks(st.novelty(features(t), KEY, BLOCK), KEY, BLOCK)


def boundaries(t):
    spans = st.repeat_spans(t.shared("repeats", repeats), cell_marks(t), KEY)
    return st.merge_boundaries(peaks(t), spans, cell_marks(t), cell_tracks(t), KEY, MARK_BLOCK)


@query(
    "cell_features",
    f"""WITH {FEAT}
        SELECT track_id, cell, len(f) AS size, round(f[1], 6) AS first, round(f[40], 6) AS middle,
               round(f[65], 6) AS last FROM feat""",
)
def cell_features(t):
    at = lambda k: F.round(F.element_at("feature", k), 6)
    return features(t).select(
        "track_id", "cell", F.size("feature").alias("size"), at(1).alias("first"),
        at(40).alias("middle"), at(65).alias("last"),
    )


@query(
    "self_similarity",
    f"""WITH {FEAT}, {SIM}
        SELECT track_id, i, j, round(similarity, 6) AS similarity FROM sim
        WHERE i < j AND similarity >= 0.3""",
)
def self_similarity(t):
    return st.self_similarity(features(t), KEY, 0.3, BLOCK).select(
        "track_id", "i", "j", F.round("similarity", 6).alias("similarity")
    )


@query(
    "novelty",
    f"""WITH {FEAT}, {SIM}, {CEND}, {NOV}
        SELECT track_id, idx, round(score, 6) AS score FROM nov""",
)
def novelty(t):
    return st.novelty(features(t), KEY, BLOCK).withColumn("score", F.round("score", 6))


@query(
    "novelty_peaks",
    f"WITH {FEAT}, {SIM}, {CEND}, {NOV} SELECT track_id, idx, round(score, 6) AS score FROM peaks",
)
def novelty_peaks(t):
    return peaks(t).withColumn("score", F.round("score", 6))


@query(
    "repeat_candidates",
    f"""WITH {FEAT}, {SIM}, {CEND}, {CAND}
        SELECT track_id, left_cell, right_cell, length, round(score, 6) AS score FROM cand""",
)
def repeat_candidates(t):
    return candidates(t).select(
        "track_id", F.col("left").alias("left_cell"), F.col("right").alias("right_cell"),
        "length", F.round("score", 6).alias("score"),
    )


@query(
    "select_repeats",
    f"""WITH {FEAT}, {SIM}, {CEND}, {CAND}, {REP}
        SELECT track_id, group_id, l AS left_cell, r AS right_cell, n AS length,
               round(score, 6) AS score FROM rep""",
)
def select_repeats(t):
    return repeats(t).select(
        "track_id", "group_id", F.col("left").alias("left_cell"),
        F.col("right").alias("right_cell"), "length", F.round("score", 6).alias("score"),
    )


@query(
    "repeat_spans",
    f"""WITH {FEAT}, {SIM}, {CEND}, {CAND}, {REP}, {SPANS}
        SELECT track_id, group_id, span_id, round(confidence, 6) AS confidence, start_anchor,
               end_anchor, start_sample, end_sample FROM sp""",
)
def repeat_spans(t):
    return st.repeat_spans(repeats(t), cell_marks(t), KEY).withColumn(
        "confidence", F.round("confidence", 6)
    )


@query(
    "merge_boundaries",
    f"""WITH {FEAT}, {SIM}, {CEND}, {NOV}, {CAND}, {REP}, {SPANS}, {BND}
        SELECT track_id, boundary_id, sample, round(confidence, 6) AS confidence, sources
        FROM bnd""",
)
def merge_boundaries(t):
    return boundaries(t).select(
        "track_id", "boundary_id", "sample", F.round("confidence", 6).alias("confidence"),
        F.array_join("sources", ",").alias("sources"),
    )


CHOICES = """edges AS (
  SELECT track_id, n, sample + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS sample,
         CASE WHEN n % 4 = 0 THEN NULL WHEN n % 7 = 0 THEN 'boundary-999' ELSE boundary_id END AS bid
  FROM bnd UNION ALL SELECT track_id, 0, 0, NULL FROM ct
  UNION ALL SELECT track_id, 1000000, duration_samples, NULL FROM ct),
choices AS (
  SELECT track_id, 'sec-' || sample AS section_id,
         CASE WHEN n % 5 = 0 AND n > 0 THEN 'label' END AS label,
         sample AS start_sample, bid AS start_bid, lead(sample) OVER w AS end_sample,
         lead(bid) OVER w AS end_bid
  FROM edges WINDOW w AS (PARTITION BY track_id ORDER BY sample)),
applied AS (
  SELECT c.track_id, c.section_id, c.start_sample, c.end_sample, c.label,
         CASE WHEN c.label IS NOT NULL
                OR (c.start_sample <> 0 AND a.sample IS DISTINCT FROM c.start_sample)
                OR (c.end_sample <> ct.duration_samples AND b.sample IS DISTINCT FROM c.end_sample)
              THEN 'manual' ELSE 'automatic' END AS origin,
         least(CASE WHEN c.start_sample <> 0 THEN a.confidence END,
               CASE WHEN c.end_sample <> ct.duration_samples THEN b.confidence END) AS conf,
         CASE WHEN (c.start_sample <> 0 AND c.start_bid IS NOT NULL AND a.sample IS NULL)
                OR (c.end_sample <> ct.duration_samples AND c.end_bid IS NOT NULL
                    AND b.sample IS NULL)
              THEN 'unknown_boundary' END AS reason
  FROM choices c JOIN ct ON ct.track_id = c.track_id
  LEFT JOIN bnd a ON a.track_id = c.track_id AND a.boundary_id = c.start_bid
  LEFT JOIN bnd b ON b.track_id = c.track_id AND b.boundary_id = c.end_bid
  WHERE c.end_sample IS NOT NULL)"""


def choices(t, bounds):
    n = F.regexp_extract("boundary_id", r"(\d+)$", 1).cast("long")
    moved = bounds.select(
        "track_id", n.alias("n"),
        (F.col("sample") + F.when(n % 3 == 0, 1).otherwise(0)).alias("sample"),
        F.when(n % 4 == 0, None).when(n % 7 == 0, "boundary-999")
        .otherwise(F.col("boundary_id")).alias("bid"),
    )
    nothing = F.lit(None).cast("string")
    tracks = cell_tracks(t)
    edges = moved.unionByName(
        tracks.select("track_id", v.long(0).alias("n"), v.long(0).alias("sample"),
                      nothing.alias("bid"))
    ).unionByName(
        tracks.select("track_id", v.long(1_000_000).alias("n"),
                      F.col("duration_samples").alias("sample"), nothing.alias("bid"))
    )
    nxt = neighbour(
        edges, KEY, ["sample"], int_div("sample", MARK_BLOCK), ["sample", "bid"], "next", 1
    )
    return nxt.where("next is not null").select(
        "track_id",
        F.concat(F.lit("sec-"), F.col("sample").cast("string")).alias("section_id"),
        F.when((F.col("n") % 5 == 0) & (F.col("n") > 0), "label").alias("label"),
        F.col("sample").alias("start_sample"),
        F.col("bid").alias("start_boundary_id"),
        F.col("next.sample").alias("end_sample"),
        F.col("next.bid").alias("end_boundary_id"),
    )


def applied(t):
    bounds = t.shared("boundaries", boundaries)
    return st.apply_selection(choices(t, bounds), bounds, cell_tracks(t), KEY)


@query(
    "apply_selection",
    f"""WITH {FEAT}, {SIM}, {CEND}, {NOV}, {CAND}, {REP}, {SPANS}, {BND}, {CHOICES}
        SELECT track_id, section_id, start_sample, end_sample, label, origin,
               CASE WHEN origin = 'automatic' THEN round(conf, 6) END AS confidence, reason
        FROM applied""",
)
def apply_selection(t):
    return applied(t).withColumn("confidence", F.round("confidence", 6))


@query(
    "selection_policy",
    f"""WITH {v.EV}
        SELECT DISTINCT track_id FROM ev WHERE name = 'purchase'
          AND track_id IN (SELECT track_id FROM ev WHERE name = 'signup')""",
)
def selection_policy(t):
    existing = v.events(t).where("name = 'signup'")
    return st.selection_policy(v.beats(t), existing, KEY, "require-empty")


@query(
    "selection_complete",
    f"""WITH {v.EV}, {v.SEC}, {v.TR}
        SELECT track_id, 'structure_selection_incomplete' AS reason
        FROM (SELECT track_id, min(start_sample) AS a, max(end_sample) AS b FROM sec GROUP BY 1)
        JOIN tr USING (track_id) WHERE a <> 0 OR b <> {v.DURATION}""",
)
def selection_complete(t):
    return st.incomplete_selections(v.sections(t), v.tracks(t), KEY)


@query(
    "auto_sections",
    f"""WITH {v.EV}, {v.SIG}, d AS (
          SELECT track_id, sample,
                 abs(value - lag(value) OVER (PARTITION BY track_id ORDER BY idx)) AS nv FROM sig),
        st AS (SELECT track_id, avg(nv) + stddev_pop(nv) AS thr FROM d GROUP BY 1),
        c AS (SELECT d.track_id, list(sample ORDER BY round(nv, 9) DESC, sample DESC) AS s
              FROM d JOIN st ON st.track_id = d.track_id
              WHERE nv >= thr AND sample >= {GAP} AND {v.DURATION} - sample >= {GAP} GROUP BY 1),
        p AS (SELECT track_id, list_reduce(list_transform(s, lambda x: [x]), lambda acc, x:
                CASE WHEN len(acc) >= 6 OR len(list_filter(acc, lambda a: abs(a - x[1]) < {GAP})) > 0
                     THEN acc ELSE list_append(acc, x[1]) END) AS picks FROM c),
        e AS (SELECT DISTINCT h.track_id,
                list_sort(list_concat([0, {v.DURATION}], coalesce(p.picks, []))) AS x
              FROM hops h LEFT JOIN p ON p.track_id = h.track_id),
        k AS (SELECT track_id, x, unnest(range(1, len(x))) AS i FROM e)
        SELECT track_id, printf('auto-%03d', i) AS section_id, CAST(x[i] AS BIGINT) AS start_sample,
               CAST(x[i + 1] AS BIGINT) AS end_sample, 'automatic' AS origin FROM k""",
)
def auto_sections(t):
    return st.auto_sections(v.signals(t), v.tracks(t), KEY, v.HOP, GAP, v.HOP_BLOCK)


@query(
    "structure_summary",
    f"""WITH {FEAT}, {SIM}, {CEND}, {NOV}, {CAND}, {REP}, {SPANS}, {BND}, {CHOICES}
        SELECT ct.track_id, ct.cells - 1 AS beats,
          (SELECT count(*) FROM bnd x WHERE x.track_id = ct.track_id) AS boundaries,
          (SELECT count(*) FROM rep x WHERE x.track_id = ct.track_id) AS repeated_groups,
          (SELECT count(*) FROM applied x WHERE x.track_id = ct.track_id) AS sections,
          (SELECT count(*) FROM applied x WHERE x.track_id = ct.track_id AND origin = 'manual')
            AS manual_sections
        FROM ct""",
)
def structure_summary(t):
    return st.structure_summary(
        cell_marks(t), t.shared("boundaries", boundaries), t.shared("repeats", repeats),
        applied(t), KEY,
    )
