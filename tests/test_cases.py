"""Small exact cases of every area."""

import copy
import json
import random
import re
import wave

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import blocks, clock
from trackloom.functions import text as tx
from trackloom.operators import compare as cp
from trackloom.operators import lineage as ln
from trackloom.operators import lyrics as ly
from trackloom.operators import resolve as rs
from trackloom.operators import rules as ru
from trackloom.operators import signals as sg
from trackloom.operators import structure as st
from trackloom.operators import tiles
from trackloom.plans import all_queries
from trackloom.sources import artifacts as ar
from trackloom.sources import files as fl
from trackloom.sources import pcm
from trackloom.sources import schemas as sc
from trackloom.sources.tables import materialize
from trackloom.streaming import hops as streams

KEY = ["track_id"]


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_clock_vectors(spark):
    row = spark.range(1).select(
        clock.sample_at_frame(F.lit(900), 48000, 30, 1).alias("a"),
        clock.sample_at_frame(F.lit(1), 48000, 30000, 1001).alias("b"),
        clock.first_frame_at_sample(F.lit(1601), 48000, 30, 1).alias("c"),
        clock.sample_at_frame(F.lit(2**53 - 1), 48000, 30, 1).alias("over"),
        clock.frame_seconds(F.lit(900), 30, 1).alias("s"),
        clock.parse_rate(F.lit("30000/1001")).alias("r"),
        clock.parse_rate(F.lit("x/2")).alias("bad"),
    ).first()
    assert (row.a, row.b, row.c, row.over, row.s) == (1440000, 1601, 2, None, 30.0)
    assert (row.r.num, row.r.den, row.bad) == (30000, 1001, None)


def test_clock_round_trip(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**12),) for _ in range(200)]
    df = table(spark, rows, "f long").select(
        "f", clock.sample_at_frame("f", 48000, 30000, 1001).alias("s")
    ).withColumn("back", clock.first_frame_at_sample("s", 48000, 30000, 1001))
    for r in df.collect():
        assert r.s == r.f * 48000 * 1001 // 30000
        assert r.back == -(-r.s * 30000 // (48000 * 1001))


def test_pulse_frames(spark):
    events = table(
        spark, [(1, "onset", s) for s in (48000, 96000, 144000)],
        "track_id long, name string, sample long",
    )
    tracks = table(spark, [(1,), (2,)], "track_id long")
    rows = clock.pulse_frames(events, "onset", 48000, 30, 1, tracks).collect()
    assert sorted((r.track_id, r.frame or 0, r.reason) for r in rows) == [
        (1, 30, None), (1, 60, None), (1, 90, None), (2, 0, "missing_pulse_event")
    ]


def test_signal_lookup(spark):
    signal = table(spark, [(1, 0, 0.0), (1, 1, 1.0), (1, 2, 0.5)], "track_id long, idx long, value double")
    at = table(spark, [(1, s) for s in (0, 50, 100, 150, 999)], "track_id long, sample long")
    got = sg.sample_signal(signal, at, KEY, 100, 2)
    assert {r.sample: r.level for r in got.collect()} == {0: 0, 50: 0.5, 100: 1, 150: 0.75, 999: 0.5}


def test_silence_normalizes_to_zero(spark):
    df = table(spark, [(1, float("nan")), (1, 0.0), (2, -3.0), (2, 1.5)], "track_id long, value double")
    got = sorted((r.track_id, r.value) for r in sg.normalize(df, KEY).collect())
    assert got == [(1, 0.0), (1, 0.0), (2, 0.0), (2, 0.5)]


def test_onset_and_low_band(spark):
    n = 24_000
    t = np.arange(n)
    x = np.where(t >= n // 2, 0.4 * np.sin(2 * np.pi * 80 * t / 48_000), 0.01)
    df = spark.createDataFrame([(1, int(i), float(v)) for i, v in enumerate(x)],
                               "track_id long, sample long, value double")
    frames = sg.sample_frames(df, KEY, 512, 1024)
    low = {r.idx: r.value for r in sg.band_energy(frames, KEY, 48_000.0).collect()}
    assert len(low) == -(-n // 512)
    first = np.mean([v for i, v in low.items() if i < 20])
    assert np.mean([v for i, v in low.items() if 26 <= i < 44]) > 4 * first


def test_length_plan(spark):
    df = table(spark, [(1, 48000, 48001), (2, 48000, 47999), (3, 5, 5)],
               "track_id long, natural_samples long, target_samples long")
    got = {r.track_id: (r.action, r.delta_samples) for r in sg.length_plan(df).collect()}
    assert got == {1: ("pad", 1), 2: ("trim", -1), 3: ("none", 0)}


def _cells(spark, pitches, energy):
    eye = np.eye(12)
    rows = [
        (1, i, (eye[p] if p is not None else np.zeros(12)).tolist(), float(e))
        for i, (p, e) in enumerate(zip(pitches, energy))
    ]
    return spark.createDataFrame(rows, "track_id long, cell long, vector array<double>, energy double")


def _structure(spark, cells, n):
    feats = st.cell_features(cells)
    counts = table(spark, [(1, n, n * 48000)], "track_id long, cells long, duration_samples long")
    marks = table(spark, [(1, i, i * 48000) for i in range(n + 1)], "track_id long, anchor long, sample long")
    similar = st.self_similarity(feats, KEY, tile=5)
    reps = st.select_repeats(st.repeat_candidates(similar, counts, KEY, 4), KEY)
    peaks = st.pick_peaks(st.novelty(feats, KEY, 4), KEY, 4)
    spans = st.repeat_spans(reps, marks, KEY)
    return st.merge_boundaries(peaks, spans, marks, counts, KEY, 200_000), spans


def test_repeated_structure(spark):
    pitches = [0, 2, 4, 5, 7, 9, 11, 7, 0, 2, 4, 5, 1, 3, 6, 10]
    bounds, spans = _structure(spark, _cells(spark, pitches, [.4, .6, .5, .7, .3, .8, .2, .6] * 2), 16)
    found = {(r.start_sample, r.end_sample) for r in spans.collect()}
    assert {(0, 192000), (384000, 576000)} <= found
    samples = [r.sample for r in bounds.orderBy("sample").collect()]
    assert samples and 0 not in samples and 16 * 48000 not in samples
    assert len(samples) == len(set(samples))


def test_silence_has_no_structure(spark):
    bounds, spans = _structure(spark, _cells(spark, [None] * 16, [0.0] * 16), 16)
    assert bounds.count() == 0 and spans.count() == 0


def test_similarity_equals_matrix(spark):
    rng = np.random.default_rng(4)
    data = rng.random((40, 6))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    df = spark.createDataFrame([(1, i, v.tolist(), 1.0) for i, v in enumerate(data)],
                               "track_id long, cell long, feature array<double>, energy double")
    got = {(r.i, r.j) for r in st.self_similarity(df, KEY, 0.9, tile=7).collect()}
    full = data @ data.T
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if full[i, j] >= 0.9}


def test_tiles_travel_in_groups(spark, monkeypatch):
    """A tile is sent once to each group that it meets; groups of all sizes give the full matrix."""
    tables = []

    def written(df):
        tables.append(materialize(df))
        return tables[-1]

    monkeypatch.setattr(st, "materialize", written)
    monkeypatch.setattr(st, "TASK_CELLS", 48, raising=False)
    data = np.random.default_rng(6).random((200, 5))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    rows = [(t, i, v.tolist(), 1.0) for t in (1, 2) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "track_id long, cell long, feature array<double>, energy double")
    got = [(r.track_id, r.i, r.j) for r in st.self_similarity(df, KEY, 0.3, tile=6).collect()]
    full = data @ data.T
    assert sorted(got) == [(t, i, j) for t in (1, 2) for i in range(200) for j in range(i + 1, 200) if full[i, j] >= 0.3]
    pairs = next(t for t in tables if "_group_a" in t.columns)
    task = ["track_id", "_group_a", "_group_b"]
    sent = pairs.select(*task, F.explode(F.array("_tile_a", "_tile_b")).alias("_tile")).distinct().count()
    assert pairs.select(*task).distinct().count() > 20 and sent * 2 < pairs.count()


def test_pivots_rule_out_most_tiles(spark):
    """Clusters scattered over the track, one of them a third of its cells: few tiles meet, no entry is lost."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(24, 12))
    which = np.concatenate([np.repeat(np.arange(24), 20), np.zeros(240, dtype=int)])
    rng.shuffle(which)
    data = centres[which] + 0.03 * rng.normal(size=(720, 12))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    data[5] = 0.0
    rows = [(1, i, v.tolist(), float(i % 3)) for i, v in enumerate(data)] + [(2, 4, data[0].tolist(), 1.0)]
    df = spark.createDataFrame(rows, "track_id long, cell long, feature array<double>, energy double")
    full = np.clip(data @ data.T, 0, 1)
    got = {(r.i, r.j): (r.similarity, r.loud) for r in st.self_similarity(df, KEY, 0.86, tile=16).collect()}
    assert set(got) == {(i, j) for i in range(720) for j in range(i + 1, 720) if full[i, j] >= 0.86}
    for (i, j), (value, loud) in got.items():
        assert value == pytest.approx(full[i, j], abs=1e-12) and loud == bool(i % 3 or j % 3)
    tiles, pivots = st.pivot_tiles(df.where("cell != 5"), KEY, 16)
    n = tiles.where("track_id = 1").count()
    near = st.near_tiles(tiles, pivots, KEY, np.sqrt(2 - 2 * 0.86)).where("track_id = 1").count()
    assert near * 5 < n * (n + 1) / 2 and tiles.select(F.max(F.size("_cells"))).first()[0] <= 40


def test_gap_fill(spark):
    sections = table(spark, [(1, "a", 0, 48000), (1, "b", 96000, 120000)],
                     "track_id long, section_id string, start_sample long, end_sample long")
    tracks = table(spark, [(1, 144000), (2, 10)], "track_id long, duration_samples long")
    got = sorted(tuple(r) for r in rs.fill_gaps(sections, tracks, KEY, 10_000).select(
        "track_id", "start_sample", "end_sample", F.coalesce("section_id", F.lit("-"))).collect())
    assert got == [(1, 0, 48000, "a"), (1, 48000, 96000, "-"), (1, 96000, 120000, "b"),
                   (1, 120000, 144000, "-"), (2, 0, 10, "-")]


def test_video_frame_policies(spark):
    def at(sample, policy):
        c = F.lit
        return rs.video_frame(c(sample), c(48000), c(10), c(1), c(0), c(2), c(5), c(policy))

    row = spark.range(1).select(
        at(4800, "error").alias("a"), at(48000, "loop").alias("b"), at(48000, "hold").alias("c"),
        at(48000, "error").alias("d"),
    ).first()
    assert (row.a.frame, row.b.frame, row.c.frame) == (3, 3, 4)
    assert row.d.frame is None and row.d.reason == "media_too_short"


def test_lrc(spark):
    text = "[00:00.50]one\n[00:01.25][Chorus]\n[00:01.50]two\n[00:02.00]three"
    df = table(spark, [(1, text, 144000), (2, "[00:01]x\n[00:01]y", 144000), (3, "plain", 10)],
               "track_id long, text string, duration_samples long")
    rows = ly.lrc_cues(df, KEY).collect()
    good = sorted((r.start_sample, r.end_sample) for r in rows if r.track_id == 1)
    assert good == [(24000, 72000), (72000, 96000), (96000, 144000)]
    assert {r.track_id: r.reason for r in rows if r.track_id > 1} == {
        2: "non_monotonic_lyrics", 3: "unsupported_lyric_line"}


def test_lrc_offset_moves_later_lines_only(spark):
    df = table(spark, [(1, "[00:01]a\n[offset:500]\n[00:02]b", 480000)],
               "track_id long, text string, duration_samples long")
    assert sorted(r.start_sample for r in ly.lrc_cues(df, KEY).collect()) == [48000, 120000]


def test_srt_overlap(spark):
    good = "1\n00:00:00,000 --> 00:00:01,500\nhi\nthere\n\n2\n00:00:02,000 --> 00:00:03,000\nyou"
    df = table(spark, [(1, good, 480000), (2, good.replace("00:00:02,000", "00:00:01,000"), 480000)],
               "track_id long, text string, duration_samples long")
    rows = ly.srt_cues(df, KEY).collect()
    assert sorted((r.start_sample, r.end_sample, r.text) for r in rows if r.track_id == 1) == [
        (0, 72000, "hi\nthere"), (96000, 144000, "you")]
    assert [r.reason for r in rows if r.track_id == 2] == ["overlapping_lyrics"]


def _brute_pairs(a, b):
    rows, cols = len(a) + 1, len(b) + 1
    cost = [[i + j if not i or not j else 0 for j in range(cols)] for i in range(rows)]
    for i in range(1, rows):
        for j in range(1, cols):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1,
                             cost[i][j - 1] + 1)
    i, j, pairs = len(a), len(b), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            if a[i - 1] == b[j - 1]:
                pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def _alignment_tables(spark, texts):
    """Known texts in lines of up to nine characters (some empty), observed texts as characters."""
    lines = [(k, i // 9, "", a[i : i + 9]) for k, a, _ in texts for i in range(0, len(a), 9)]
    lines += [(k, 10**6, "", "") for k, *_ in texts]
    chars = [(k, i, c) for k, _, b in texts for i, c in enumerate(b)]
    return (
        table(spark, lines, "track_id long, line long, text string, key string").repartition(3),
        table(spark, chars, "track_id long, pos long, char string").repartition(3),
    )


@pytest.mark.parametrize("tile", [2, 7])
def test_alignment_equals_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(tiles, "STRIP", 3)
    rng = random.Random(tile)
    longest = 3 * tile
    texts = [
        (k, *("".join(rng.choice("ab\U0001d11e") for _ in range(rng.randrange(0, longest))) for _ in range(2)))
        for k in range(30)
    ]
    got = {}
    for r in ly.align_pairs(*_alignment_tables(spark, texts), KEY, tile=tile).collect():
        got.setdefault(r.track_id, []).append((r.known_pos, r.observed_pos))
    for k, a, b in texts:
        assert sorted(got.get(k, [])) == _brute_pairs(a, b)


def test_alignment_without_texts(spark):
    assert ly.align_pairs(*_alignment_tables(spark, [(1, "abc", ""), (2, "", "abc")]), KEY).count() == 0


def test_a_long_text_is_aligned_in_tiles(spark):
    """60,000 characters a side, refused by the import limits, aligned without them like the whole table at once."""
    rng = np.random.default_rng(4)
    a = "".join(rng.choice(list("abcdefgh"), 60_000))
    b = "".join(c for c in a[20_000:31_000] if rng.random() > 0.2)
    lines = spark.range(600).selectExpr("1L AS track_id", "id AS line", "'' AS text", f"substr('{a}', id * 100 + 1, 100) AS key")
    chars = spark.range(len(b)).selectExpr("1L AS track_id", "id AS pos", f"substr('{b}', id + 1, 1) AS char")
    assert ly.align_pairs(lines, chars, KEY).count() == 0
    got = sorted((r.known_pos, r.observed_pos) for r in ly.align_pairs(lines, chars, KEY, limited=False).collect())
    edge = np.arange(len(a) + 1, dtype=np.int32)
    known, observed, *_ = tiles.tile_path(
        tiles._codes(a), tiles._codes(b), np.arange(len(b) + 1, dtype=np.int32), edge, len(a), len(b)
    )
    assert got == sorted(zip(known, observed)) and len(got) > 8_000


def test_known_text_alignment(spark):
    text = "# Title\n\nalpha moon\nrepeat light\nsparse cloud\nrepeat light\nunheard ending"
    lines = ly.known_lines(table(spark, [(1, text)], "track_id long, text string"), KEY)
    words = "alpha moon repeat light sparse cloud repeat light".split()
    tokens = table(
        spark, [(1, i, w, i * 1.0, i + 0.9, 960_000) for i, w in enumerate(words)],
        "track_id long, token_idx long, word string, start double, end double, duration_samples long",
    )
    tracks = table(spark, [(1, 960_000)], "track_id long, duration_samples long")
    chars = ly.timed_chars(tokens, KEY, 100_000)
    pairs = ly.align_pairs(lines, chars, KEY)
    out = ly.repair_monotonic(ly.line_coverage(lines, pairs, chars, tracks, KEY), KEY)
    rows = out.orderBy("line").collect()
    assert [(r.line, r.status) for r in rows] == [
        (3, "matched"), (4, "matched"), (5, "matched"), (6, "matched"), (7, "unmatched")]
    assert [r.start_sample for r in rows[:4]] == [0, 96000, 192000, 288000]


def test_evaluation_gates(spark):
    lines = [(t, i, 10_000 * i + (30_000 if t == 2 else 0)) for t in (1, 2, 3) for i in range(12)]
    lines = [(t, i, None if t == 3 and i == 4 else s) for t, i, s in lines]
    found = table(spark, lines, "track_id long, line long, start_sample long")
    refs = table(spark, [(t, i, 10_000 * i) for t in (1, 2, 3) for i in range(12)],
                 "track_id long, line long, reference_sample long")
    got = {r.track_id: r for r in ly.evaluate(found, refs, KEY).collect()}
    assert [got[t].passed for t in (1, 2, 3)] == [True, False, False]
    assert (got[3].matched_reference_points, got[3].unmatched_reference_points) == (11, 1)


def test_ascii_json_like_python(spark):
    text = 'aé€😀"q" '
    df = spark.createDataFrame([(1, text)], "b long, a string")
    got = df.select(ln.canonical_json(["b", "a"]).alias("j")).first().j
    assert got == json.dumps({"a": text, "b": 1}, sort_keys=True, separators=(",", ":"))


def test_cache_key_ignores_order_and_sees_every_input(spark):
    rows = [(1, i, f"h{i}") for i in range(20)]
    ddl = "track_id long, idx long, hash string"
    key = lambda r, s="a": ln.cache_key(table(spark, r, ddl), KEY, ["idx", "hash"], F.lit(s)).first().cache_key
    base = key(rows)
    assert base == key(rows[::-1])
    assert len({base, key(rows[1:]), key(rows + rows[:1]), key(rows, "b")}) == 4


def test_stale_depth(spark):
    edges = table(spark, [("b", "a"), ("c", "b"), ("c", "a"), ("x", "y")], "from_id string, to_id string")
    got = {r.id: r.depth for r in ln.stale(edges, table(spark, [("a",)], "id string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 1}


def test_stale_holds_no_level_on_the_driver(spark, monkeypatch):
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df)

    monkeypatch.setattr(ln, "materialize", written)
    edges = table(spark, [("b", "a"), ("c", "b")], "from_id string, to_id string")
    assert ln.stale(edges, table(spark, [("a",)], "id string")).count() == 3
    assert len(plans) == 4 and not any("BroadcastHashJoin" in p for p in plans)


def test_variants_are_compared_without_copies(spark):
    clips = table(spark, [(1, r, v, 30 + (v == 2)) for r in range(3) for v in range(3)],
                  "track_id long, range_idx long, variant_idx long, frames long")
    found = cp.compare_variants(clips, KEY, ["frames"])
    assert sorted((r.range_idx, r.variant_idx, r.field) for r in found.collect()) == [(r, 2, "frames") for r in range(3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "Generate explode(sequence" not in plan


def test_reel_is_range_major(spark):
    rows = [(1, v, r, 30) for v in range(2) for r in range(2)]
    df = table(spark, rows, "track_id long, variant_idx long, range_idx long, frames long")
    got = [(r.range_idx, r.variant_idx) for r in cp.reel_order(df, KEY).orderBy("position").collect()]
    assert got == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_union_length(spark):
    df = table(spark, [(1, 0, 10), (1, 5, 20), (1, 30, 31), (1, 6, 7)],
               "track_id long, start_sample long, end_sample long")
    assert cp.union_length(df, KEY, 4).first().covered_samples == 21


@pytest.mark.parametrize("kind", sorted(sc.KINDS))
def test_every_kind_has_a_schema(spark, kind):
    assert sc.schema(kind).names[0] == "schema_version"


def test_bad_timelines_are_rejected(spark):
    good = {
        "schema_version": "0.1",
        "source": {"path": "a.wav", "sha256": "0" * 64, "sample_rate": 48000, "duration_samples": 100},
        "analysis": [],
        "signals": {"mix.rms": {"start_sample": 0, "hop_samples": 10, "values": [0.5], "unit": "n"}},
    }
    text = json.dumps(good)
    cases = {
        "good": text,
        "version": text.replace('"0.1"', '"0.2"'),
        "unknown": text[:-1] + ', "extra": 1}',
        "nested": text.replace('"unit": "n"', '"unit": "n", "gain": 1'),
        "missing": text.replace('"hop_samples": 10, ', ""),
        "bool": text.replace("48000", "true"),
        "nan": text.replace("0.5", "NaN"),
        "twice": text[:-1] + ', "analysis": []}',
        "list": "[" + text + "]",
    }
    df = table(spark, list(cases.items()), "name string, text string")
    got = {r.name: r.reasons for r in ar.check_artifacts(df, "timeline").collect()}
    assert got.pop("good") == []
    assert all(got.values()), got


FILE_REF = {"path": "x.json", "sha256": "a" * 64}
SOURCE = {"path": "a.wav", "sha256": "0" * 64, "sample_rate": 48000, "duration_samples": 480_000}
GOOD = {
    "timeline": {
        "schema_version": "0.1", "source": SOURCE,
        "analysis": [{"tool": "t", "version": "1", "parameters": {"n": 1, "deep": {"list": [1, 2.5, None, True]}}}],
        "signals": {"mix.rms": {"start_sample": 0, "hop_samples": 1000, "values": [0.5, 1, 0.25], "unit": "n"}},
        "events": [{"name": "beat", "source": "mix", "sample": 5}, {"name": "beat", "source": "mix", "sample": 900, "confidence": 1}],
        "sections": [
            {"start_sample": 0, "end_sample": 240_000, "id": "intro", "origin": "manual", "label": None},
            {"start_sample": 240_000, "end_sample": 480_000, "id": "rest", "origin": "automatic", "confidence": 0.5},
        ],
    },
    "structure": {
        "schema_version": "0.1", "source": SOURCE, "timeline": FILE_REF, "cache_key": "b" * 64,
        "analyzer": {"tool": "t", "version": "1", "parameters": {}}, "beat_samples": [100, 200, 300, 400],
        "boundaries": [{"id": "b1", "sample": 100, "confidence": 0.5, "sources": ["novelty", "g1"]},
                       {"id": "b2", "sample": 300, "confidence": 0.5, "sources": ["g1"]}],
        "repeated_groups": [{"id": "g1", "confidence": 0.9, "spans": [
            {"id": "s1", "group_id": "g1", "confidence": 0.9, "start_sample": 0, "end_sample": 100, "start_anchor_index": 0, "end_anchor_index": 1},
            {"id": "s2", "group_id": "g1", "confidence": 0.9, "start_sample": 200, "end_sample": 300, "start_anchor_index": 2, "end_anchor_index": 3},
        ]}],
    },
    "structure-selection": {
        "schema_version": "0.1", "reviewed": True, "structure": FILE_REF, "timeline": FILE_REF, "existing_sections_policy": "replace",
        "sections": [{"start_sample": 0, "end_sample": 100, "id": "a"}, {"start_sample": 100, "end_sample": 300, "id": "b"}],
    },
    "plan": {
        "schema_version": "0.1", "timeline_path": "t.json", "assets_path": "a.json", "mode": "abstract", "seed": 7,
        "layers": [{"id": "orb", "kind": "orb", "category": "abstract", "opacity": 0.5, "parameters": {"radius": 0.3, "color": "#ffffff"}},
                   {"id": "words", "kind": "captions", "category": "text"}],
        "routes": [{"source": "mix.rms", "target_layer": "orb", "target_parameter": "radius", "transform": {"kind": "linear"}}],
        "sections": [{"section_id": "intro", "layers": [{"layer_id": "orb", "enabled": False}]}],
    },
    "resolved-plan": {
        "schema_version": "0.1", "source_plan": FILE_REF, "timeline_path": "t", "timeline_sha256": "a" * 64, "assets_path": "a",
        "assets_sha256": "a" * 64, "checked_assets_path": "c", "checked_assets_sha256": "a" * 64, "mode": "abstract", "seed": 1,
        "duration_samples": 200, "routes": [],
        "spans": [{"start_sample": 0, "end_sample": 100, "layers": [{"id": "orb", "kind": "orb", "category": "abstract"}]},
                  {"start_sample": 100, "end_sample": 200, "section_id": "x", "section_origin": "manual", "transition_samples": 50,
                   "layers": [{"id": "orb", "kind": "orb", "category": "abstract"}]}],
    },
}
MUTATIONS = [
    ("timeline", lambda d: d.update(schema_version="9.0"), "wrong_version"),
    ("timeline", lambda d: d.update(unknown_field=1), "unknown:unknown_field"),
    ("timeline", lambda d: d["source"].update(sample_rate=True), "invalid_value"),
    ("timeline", lambda d: d["source"].update(duration_samples=0), "invalid_source"),
    ("timeline", lambda d: d["source"].update(sha256="not-a-hash"), "invalid_source"),
    ("timeline", lambda d: d["source"].update(path=7), "invalid_value"),
    ("timeline", lambda d: d["source"].update(path={"a": 1}), "invalid_value"),
    ("timeline", lambda d: d["events"][0].update(sample=480_000), "event_outside_track"),
    ("timeline", lambda d: d["events"][0].update(sample=1000), "events_unordered"),
    ("timeline", lambda d: d["events"][0].update(sample=1.5), "invalid_value"),
    ("timeline", lambda d: d["events"][1].update(confidence=1.5), "invalid_event"),
    ("timeline", lambda d: d["signals"]["mix.rms"].update(hop_samples=480_000), "signal_outside_track"),
    ("timeline", lambda d: d["signals"]["mix.rms"].update(values=[float("nan")]), "invalid_value"),
    ("timeline", lambda d: d["signals"]["mix.rms"].update(values=[None]), "invalid_value"),
    ("timeline", lambda d: d["analysis"][0]["parameters"].update(n=float("inf")), "invalid_value"),
    ("timeline", lambda d: d["sections"][1].update(start_sample=239_999), "sections_overlap"),
    ("timeline", lambda d: d["sections"][1].update(end_sample=480_001), "section_outside_track"),
    ("timeline", lambda d: d["sections"][1].update(id="intro"), "duplicate_section"),
    ("timeline", lambda d: d["sections"].reverse(), "sections_overlap"),
    ("structure", lambda d: d["beat_samples"].append(400), "beats_unordered"),
    ("structure", lambda d: d["boundaries"][0].update(sources=["verse"]), "unknown_evidence"),
    ("structure", lambda d: d["repeated_groups"][0]["spans"][0].update(end_sample=99), "span_off_its_anchors"),
    ("structure", lambda d: d["repeated_groups"][0]["spans"][1].update(end_anchor_index=9), "span_off_its_anchors"),
    ("structure", lambda d: d["repeated_groups"][0]["spans"][1].update(group_id="g9"), "invalid_group"),
    ("structure-selection", lambda d: d.update(reviewed=False), "not_reviewed"),
    ("structure-selection", lambda d: d["sections"][1].update(start_sample=101), "sections_not_contiguous"),
    ("structure-selection", lambda d: d.update(existing_sections_policy="implicit"), "unknown_policy"),
    ("plan", lambda d: d.update(mode="mood"), "mode_lacks_category"),
    ("plan", lambda d: d["layers"].append(dict(d["layers"][0])), "duplicate_layer"),
    ("plan", lambda d: d["layers"][0].update(opacity=1.1), "invalid_layer"),
    ("plan", lambda d: d["routes"][0].update(target_layer="absent"), "route_to_unknown_layer"),
    ("plan", lambda d: d.update(lyrics={"mode": "auto"}), "invalid_lyrics"),
    ("plan", lambda d: d.update(lyrics={"mode": "off", "path": "l.json"}), "invalid_lyrics"),
    ("plan", lambda d: d.update(seed=2**53), "invalid_seed"),
    ("plan", lambda d: d.update(seed=2**63), "invalid_value"),
    ("plan", lambda d: d.update(output={"width": 3840}), "invalid_output"),
    ("plan", lambda d: d["sections"][0]["layers"].append({"layer_id": "gone"}), "override_of_unknown_layer"),
    ("resolved-plan", lambda d: d["spans"][1].update(start_sample=101), "spans_not_contiguous"),
    ("resolved-plan", lambda d: d.update(duration_samples=300), "track_not_covered"),
    ("resolved-plan", lambda d: d["spans"][1]["layers"][0].update(id="other"), "layers_differ"),
    ("resolved-plan", lambda d: d["spans"][1].update(section_origin=None), "invalid_span"),
    ("resolved-plan", lambda d: d.update(lyrics_sha256="a" * 64), "invalid_lyrics"),
]


@pytest.mark.parametrize("kind", sorted(GOOD))
def test_each_mutation_of_a_document_is_a_violation(spark, kind):
    cases = [(0, json.dumps(GOOD[kind]), None)]
    for i, (_, mutate, code) in enumerate((m for m in MUTATIONS if m[0] == kind), 1):
        document = copy.deepcopy(GOOD[kind])
        mutate(document)
        cases.append((i, json.dumps(document), code))
    df = table(spark, cases, "i int, text string, code string")
    for r in ar.check_artifacts(df, kind, validate=True).collect():
        assert (r.code is None and r.reasons == []) or r.code in r.reasons, (r.i, r.code, r.reasons)


def test_documents_are_walked_to_any_depth(spark):
    text = json.dumps(GOOD["timeline"])
    cases = {
        "trailing_text": text + " {}",
        "duplicate:signals.": text.replace('{"mix.rms"', '{"mix.rms": {"hop_samples": 1, "values": [1], "unit": "n"}, "mix.rms"'),
        "duplicate:analysis[].parameters{}.": text.replace('{"list"', '{"list": 1, "list"'),
        "missing:signals{}.unit": text.replace(', "unit": "n"', ""),
        "invalid_json": text[:-1],
        "root_not_object": "[" * 3 + "]" * 3,
    }
    rows = [*cases.items(), ("deep", '{"a": ' + "[" * 100_000 + "]" * 100_000 + "}"), ("none", None), ("empty", "")]
    got = {r.name: r for r in ar.check_artifacts(table(spark, rows, "name string, text string"), "timeline").collect()}
    for code in cases:
        assert got[code].reasons == [code]
    assert got["deep"].reasons == got["none"].reasons == ["invalid_json"] and got["empty"].reasons == ["root_not_object"]
    odd = ar.check_artifacts(table(spark, [(text.replace(": 48000,", ': "48000",'),)], "text string"), "timeline").first()
    assert [tuple(p) for p in odd.problems] == [("invalid_value", "source.sample_rate", "string")]


def test_ranges_out_of_list_order(spark):
    df = table(spark, [(1, 0, 0, 10), (1, 1, 20, 30), (1, 2, 10, 20), (2, 0, 0, 5), (2, 1, 5, 9)],
               "track_id long, place long, start_sample long, end_sample long")
    assert ru.ordered_ranges(df, KEY, 100).count() == 0
    assert [tuple(r) for r in ru.ordered_ranges(df, KEY, 1, "place").collect()] == [("overlapping_range", 1, 10, "30")]


def test_every_hop_has_a_frame(spark):
    samples = table(spark, [(1, 0, 2.0), (1, 40, 4.0)], "track_id long, sample long, value double")
    lengths = table(spark, [(1, 55), (2, 20)], "track_id long, duration_samples long")
    got = {(r.track_id, r.idx): r.value for r in sg.hop_rms(samples, KEY, 10, 20, lengths=lengths).collect()}
    assert set(got) == {(1, i) for i in range(6)} | {(2, 0), (2, 1)}
    assert {k: x for k, x in got.items() if x} == {(1, 0): (4 / 20) ** 0.5, (1, 3): (16 / 20) ** 0.5, (1, 4): (16 / 20) ** 0.5}


def test_drift_inside_documents(spark):
    good = GOOD["timeline"]
    odd = copy.deepcopy(good)
    odd["events"][0]["sample"] = "5"
    odd["signals"]["mix.rms"]["gain"] = {"db": [1, None]}
    docs = table(spark, [(json.dumps(d),) for d in (good, odd, odd)] + [("[]",), (None,)], "text string")
    got = {(r.path, r.found, r.current_type): r.documents for r in sc.nested_drift(docs, "timeline").collect()}
    assert got == {
        ("events[].sample", "string", "bigint"): 2, ("signals{}.gain.db[]", "integer", None): 2,
        ("signals{}.gain.db[]", "null", None): 2,
    }


def test_stream_and_its_open_windows_equal_the_batch(spark, tmp_path):
    """Windows left in the state are read at the end; a second run goes on from the same state."""
    rows = [(k, f"2024-01-01 {h:02d}:{m:02d}:00", float(h * 7 + m + k)) for k in (1, 2) for h in range(6) for m in (0, 25, 50)]
    schema = "k long, ts string, value double"
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
    args = ("k", "ts", "value", "2 hours", "1 hour", "10 minutes")
    found = lambda df: sorted((r.k, str(r.window_start), str(r.window_end), round(r.rms, 9)) for r in df.collect())
    for part in ("ts < '2024-01-01 03:00:00'", "ts >= '2024-01-01 03:00:00'"):
        events.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.hop_rms_stream(
            spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), *args)
        so_far = streams.hop_rms_to_end(stream, str(tmp_path / "run"), "k")
        here = events.where("ts < '2024-01-01 03:00:00'") if part.startswith("ts <") else events
        assert found(so_far) == found(streams.hop_rms_stream(here, *args))


def test_reference_points_must_be_points(spark):
    """A repeated line, a negative start or no start: no figures, and the reason."""
    lines = table(spark, [(k, i, 1000 * i) for k in range(4) for i in range(12)], "track_id long, line long, start_sample long")
    refs = [(k, i, 1000 * i + 10) for k in range(4) for i in range(12)]
    refs += [(1, 3, 5)]
    refs = [(k, i, -1 if (k, i) == (2, 4) else None if (k, i) == (3, 4) else s) for k, i, s in refs]
    out = ly.evaluate(lines, table(spark, refs, "track_id long, line long, reference_sample long"), KEY)
    got = {r.track_id: (r.reason, r.passed, r.median_absolute_error_samples) for r in out.collect()}
    bad = ("invalid_reference_points", False, None)
    assert got == {0: (None, True, 10), 1: bad, 2: bad, 3: bad}


def test_each_signal_has_its_own_clock(spark):
    signals = table(spark, [(k, i, float(i * i)) for k in (1, 2) for i in range(4)], "track_id long, idx long, value double")
    clocks = table(spark, [(1, 0, 10), (2, 100, 20)], "track_id long, start_sample long, hop_samples long")
    points = table(spark, [(k, s) for k in (1, 2) for s in (0, 15, 110, 150, 900)], "track_id long, sample long")
    got = {(r.track_id, r.sample): r.level for r in sg.sample_signal(signals, points, KEY, 10, 2, clocks=clocks).collect()}
    assert [got[1, s] for s in (0, 15, 110, 150, 900)] == [0.0, 2.5, 9.0, 9.0, 9.0]
    assert [got[2, s] for s in (0, 15, 110, 150, 900)] == [0.0, 0.0, 0.5, 6.5, 9.0]
    steps = {(r.track_id, r.sample): r.novelty for r in sg.diff_novelty(signals, KEY, 10, 2, clocks=clocks).collect()}
    assert steps == {(1, 10): 1.0, (1, 20): 3.0, (1, 30): 5.0, (2, 120): 1.0, (2, 140): 3.0, (2, 160): 5.0}


def test_frame_counts_are_compared(spark):
    stamps = table(spark, [(k, i * 3003) for k in (1, 2) for i in range(3)], "track_id long, timestamp long")
    probes = table(spark, [(1, 3), (2, 4), (3, 1)], "track_id long, frame_count long").selectExpr(
        "*", "30000L fps_num", "1001L fps_den", "30000L avg_fps_num", "1001L avg_fps_den", "1L tb_num", "90000L tb_den")
    out = ru.constant_rate(stamps, probes, KEY, 10_000).collect()
    assert sorted((r.rule, r.track_id, r.detail) for r in out) == [("frame_count", 2, "3"), ("frame_count", 3, "0")]


def test_schema_drift(spark):
    stored = spark.createDataFrame([], "schema_version string, ranges array<struct<id:long>>")
    got = {r.path for r in sc.schema_drift(spark, stored.schema, "preview").collect()}
    assert "ranges[].id" in got and "ranges[].role" in got


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "out")
    df = table(spark, [(1, "a"), (2, "b")], "k long, v string")
    assert fl.write_once(df, path) == "written"
    assert fl.write_once(df.repartition(3), path) == "cached"
    assert fl.write_once(df.where("k = 1"), path) == "conflict"
    assert spark.read.parquet(path).count() == 2


def test_white_space_of_any_script(spark):
    wide, hard = "\u3000", "\u00a0"
    text = f"{wide}[Chorus]{hard}\n{wide}\n{hard}first{wide}\n{wide}## Verse\nsecond"
    schema = "track_id long, text string, duration_samples long"
    rows = ly.known_lines(table(spark, [(1, text, 10)], schema), KEY).orderBy("line").collect()
    assert [(r.line, r.text, r.reason) for r in rows] == [(3, "first", None), (5, "second", None)]
    lrc = f"[00:01.00]{wide}one{hard}\n{wide}{hard}\n[00:02.00]{hard}[Bridge]\n{wide}[offset:0]"
    cues = ly.lrc_cues(table(spark, [(1, lrc, 96_000)], schema), KEY).collect()
    assert [(c.start_sample, c.end_sample, c.text, c.reason) for c in cues] == [(48_000, 96_000, "one", None)]


HUGE = "9" * 40


def _imported(spark, read, docs):
    schema = "track_id long, text string, duration_samples long"
    rows = [(k, text, 96_000_000) for k, text in enumerate(docs)]
    out = {}
    for r in read(table(spark, rows, schema), KEY).orderBy("track_id", "cue_idx").collect():
        out.setdefault(r.track_id, []).append(r.reason or (r.start_sample, r.end_sample, r.text))
    return [out[k] for k in range(len(docs))]


def test_clocks_and_offsets_of_many_digits_refuse_one_document_only(spark):
    """A number beyond 64 bits is out of bounds, or no clock, and the other documents are read."""
    got = _imported(spark, ly.lrc_cues, [
        "[00:01.00]one", f"[offset:{HUGE}]\n[00:01.00]one", f"[offset:-{'8' * 18}]\n[00:01.00]one",
        f"[offset:{'7' * 20}]\n[00:01]one", f"[00:01.00]one\n[offset:{HUGE}]", "[00:99.00]one",
        f"[{'1' * 30}:01.00]one", "", None, "[offset:5]\n[offset:+1000]\n[00:01]a\n[offset:0]\n[00:03]b",
    ])
    assert got == [
        [(48_000, 96_000_000, "one")], ["lyrics_out_of_bounds"], ["lyrics_out_of_bounds"], ["lyrics_out_of_bounds"],
        [(48_000, 96_000_000, "one")], ["invalid_lyric_timestamp"], ["unsupported_lyric_line"], ["no_lyric_cues"],
        ["no_lyric_cues"], [(96_000, 144_000, "a"), (144_000, 96_000_000, "b")],
    ]
    cue = "00:00:01,000 --> 00:00:02,000\none"
    late = lambda h: f"{h}:00:01,000 --> {h}:00:02,000\none"
    got = _imported(spark, ly.srt_cues, [
        cue, late("1" * 17), late("1" * 20), late("1" * 27), f"00:00:01,000 --> {HUGE}:00:02,000\none",
        f"{HUGE}:00:01,000 --> 00:00:02,000\none", "00:99:01,000 --> 00:00:02,000\none", "", None,
        f"1\n{cue}\n\n2\n00:00:01,500 --> 00:00:03,000\n[Chorus]",
    ])
    assert got == [
        [(48_000, 96_000, "one")], ["lyrics_out_of_bounds"], ["lyrics_out_of_bounds"], ["lyrics_out_of_bounds"],
        ["lyrics_out_of_bounds"], ["invalid_lyric_range"], ["invalid_lyric_timestamp"], ["invalid_srt_block"],
        ["invalid_srt_block"], ["overlapping_lyrics"],
    ]
    clocks = table(spark, [("1" * n,) for n in (2, 11, 12, 17, 20, 60)], "h string").select(
        clock.srt_samples(F.col("h"), F.lit("00"), F.lit("01"), F.lit("500")).alias("s")
    )
    assert [r.s for r in clocks.collect()] == [
        (11 * 3_600_000 + 1500) * 48, (11_111_111_111 * 3_600_000 + 1500) * 48, None, None, None, None]


def test_import_facts(spark):
    schema = "track_id long, text string, duration_samples long"
    lrc = "[offset:250]\n[00:01.00]one\n[00:02.00][Chorus]\n[offset:-100]\n[00:03.00]two"
    facts = ly.import_facts(table(spark, [(1, lrc, 960_000), (2, "", 960_000)], schema), KEY, "lrc")
    assert sorted(tuple(r) for r in facts.collect()) == [
        (1, "lrc", "next_start_or_song_end", -4800, 1, None), (2, "lrc", "next_start_or_song_end", None, None, "no_lyric_cues")]
    srt = "1\n00:00:01,000 --> 00:00:02,000\n[Verse]\n\n2\n00:00:02,000 --> 00:00:03,000\nhey"
    facts = ly.import_facts(table(spark, [(1, srt, 960_000)], schema), KEY, "srt")
    assert tuple(facts.first()) == (1, "srt", "explicit", None, 1, None)


def test_documents_are_imported_without_a_shuffle(spark):
    df = table(spark, [(1, "[00:01]a", 960_000)], "track_id long, text string, duration_samples long")
    for read in (ly.lrc_cues, ly.srt_cues):
        plan = read(df, KEY)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def _wav_file(path, frames, channels=2, width=3):
    with wave.open(str(path), "wb") as audio:
        audio.setnchannels(channels)
        audio.setsampwidth(width)
        audio.setframerate(48_000)
        audio.writeframes(b"".join(int(v).to_bytes(width, "little", signed=True) * channels for v in frames))


def test_a_wav_file_is_read_in_many_tasks(spark, tmp_path):
    """Ranges of 1,000 bytes give the same blocks as the whole file, whatever the letter case of the name."""
    rng = np.random.default_rng(2)
    (tmp_path / "deep").mkdir()
    long, short = rng.integers(-(1 << 23), 1 << 23, 5_003), rng.integers(-(1 << 23), 1 << 23, 7)
    _wav_file(tmp_path / "deep" / "A.WAV", long)
    _wav_file(tmp_path / "b.wav", short, channels=1)
    _wav_file(tmp_path / "c.Wav", [1, 2, 3], width=2)
    _wav_file(tmp_path / "none.wav", [])
    whole = (tmp_path / "deep" / "A.WAV").read_bytes()
    extra = b"LIST" + (5).to_bytes(4, "little") + b"abcde\0"
    (tmp_path / "chunk.wav").write_bytes(whole[:36] + extra + whole[36:])
    (tmp_path / "cut.wav").write_bytes(whole[:44 + 6 * 100 + 4])
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxx")
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no audio")
    for split in (1_000, 1 << 26):
        df = fl.read_pcm(spark, str(tmp_path), block=64, split_bytes=split)
        assert df.rdd.getNumPartitions() == 1 if split > 1_000 else df.rdd.getNumPartitions() > 60
        rows = df.orderBy("path", "block_idx").collect()
        by = {}
        for r in rows:
            by.setdefault(r.path.rpartition("/")[2], []).append(r)
        for name, values in (("A.WAV", long), ("chunk.wav", long), ("b.wav", short), ("cut.wav", long[:100])):
            assert [r.block_idx for r in by[name]] == list(range(-(-len(values) // 64)))
            assert np.array_equal(np.concatenate([r.samples for r in by[name]]) * (1 << 23), values)
        assert (by["A.WAV"][3].sample_rate, by["A.WAV"][3].channels, by["A.WAV"][3].frames) == (48_000, 2, 5_003)
        assert [(r.reason, r.sample_width) for r in by["c.Wav"]] == [("not_24_bit", 2)]
        assert {n: by[n][0].reason for n in ("bad.wav", "empty.wav")} == dict.fromkeys(
            ("bad.wav", "empty.wav"), "invalid_wav: not a RIFF/WAVE file")
        assert set(by) == {"A.WAV", "chunk.wav", "b.wav", "c.Wav", "cut.wav", "bad.wav", "empty.wav"}


def test_one_long_line_refuses_the_whole_document(spark):
    df = table(spark, [(1, "short\n" + "x" * 241), (2, "!" * 300), (3, "")], "track_id long, text string")
    rows = sorted((r.track_id, r.line or 0, r.reason) for r in ly.known_lines(df, KEY).collect())
    assert rows == [(1, 1, "lyric_text_too_long"), (1, 2, "lyric_text_too_long"),
                    (2, 0, "lyric_text_too_long"), (3, 0, "no_lyric_lines")]


def test_a_refused_track_says_why_its_lines_are_unmatched(spark, monkeypatch):
    monkeypatch.setattr(ly, "MAX_OBSERVED", 3)
    lines = table(spark, [(1, 1, "abcd", "abcd"), (2, 1, "abc", "abc")],
                  "track_id long, line long, text string, key string")
    chars = table(spark, [(k, i, c, i * 100, i * 100 + 100) for k, word in ((1, "abcd"), (2, "abc"))
                          for i, c in enumerate(word)],
                  "track_id long, pos long, char string, start_sample long, end_sample long")
    tracks = table(spark, [(1, 960_000), (2, 960_000)], "track_id long, duration_samples long")
    pairs = ly.align_pairs(lines, chars, KEY)
    out = ly.line_coverage(lines, pairs, chars, tracks, KEY).orderBy("track_id").collect()
    assert [(r.status, r.reason) for r in out] == [
        ("unmatched", "alignment_evidence_too_large"), ("matched", None)]


def test_routes_and_references_belong_to_their_track(spark):
    spec = rs.spec_table(spark)
    routes = table(spark, [(1, "rms", "orb", "y", "linear", {"min": 0.0, "max": 1.0}),
                           (2, "rms", "orb", "y", "linear", {"min": 0.0, "max": 1.0})],
                   "track_id long, source string, kind string, target_parameter string, "
                   "transform string, params map<string,double>")
    signals = table(spark, [(1, "rms"), (2, "flux")], "track_id long, name string")
    got = {r.track_id: r.reason for r in rs.resolve_routes(routes, signals, spec, KEY).collect()}
    assert got == {1: None, 2: "missing_route_signal"}

    layers = table(spark, [(1, "a", "image"), (2, "a", "image"), (3, "a", "image")],
                   "track_id long, asset_id string, kind string")
    assets = table(spark, [(1, "a", "image"), (2, "a", "video")], "track_id long, asset_id string, type string")
    got = {r.track_id: r.reason for r in rs.check_refs(layers, assets, KEY).collect()}
    assert got == {2: "asset_type_mismatch", 3: "unknown_asset"}

    levels = table(spark, [(k, "rms", 0, 0.5) for k in (1, 2)],
                   "track_id long, source string, frame long, level double")
    own = table(spark, [(1, 0, "rms", "orb", "y", "linear", {"min": 0.0, "max": 1.0}),
                        (2, 0, "rms", "orb", "x", "smooth", {"min": 0.0, "max": 0.5})],
                "track_id long, route_idx int, source string, target_layer string, "
                "target_parameter string, transform string, params map<string,double>")
    rows = sorted(rs.route_values(levels, own, KEY, 1 / 30, 8).select(
        "track_id", "target_parameter", "value").collect())
    assert [tuple(r) for r in rows] == [(1, "y", 0.5), (2, "x", 0.25)]


def test_video_parameters_are_bounded_by_the_probe(spark):
    layers = table(spark, [
        (1, "video", {}, 90, 480_000),
        (2, "video", {"in_frame": "90", "muted": "false", "end_behavior": "bounce"}, 90, 480_000),
        (3, "video", {"in_frame": "10", "out_frame": "10", "offset_samples": "480000"}, 90, 480_000),
    ], "track_id long, kind string, parameters map<string,string>, frame_count long, duration_samples long")
    rows = rs.resolve_params(layers, rs.spec_table(spark), KEY).collect()
    first = {r.parameter: r.value for r in rows if r.track_id == 1}
    assert (first["in_frame"], first["out_frame"], first["end_behavior"], first["muted"]) == ("0", "90", "error", "true")
    bad = lambda k: {r.parameter: r.reason for r in rows if r.track_id == k and r.reason}
    assert bad(1) == {}
    assert bad(2) == {"in_frame": "out_of_range_or_fraction", "out_frame": "out_of_range_or_fraction",
                      "muted": "media_audio_forbidden", "end_behavior": "invalid_choice"}
    assert bad(3) == {"out_frame": "out_of_range_or_fraction", "offset_samples": "out_of_range_or_fraction"}


def test_large_clock_values_do_not_overflow(spark):
    big = F.lit(2**53 - 1)
    c = F.lit
    shown = rs.video_frame(big, c(1), big, c(1), c(0), c(2), c(5), c("hold"))
    row = spark.range(1).select(shown.alias("v")).first().v
    assert row.frame is None and row.reason == "time_overflow"
    trim = table(spark, [(2**53 - 1, 2**53 - 1, 1001, 2**53 - 1)],
                 "frame_count long, fps_num long, fps_den long, duration_samples long").selectExpr(
        "*", "cast(null as long) in_frame", "cast(null as long) out_frame",
        "cast(null as long) offset_samples", "cast(null as string) end_behavior")
    assert rs.check_trim(trim).first().reason == "media_too_short"


def test_safe_path_follows_the_parts(spark):
    paths = ["a/../b", "a/../../b", "../a", "a/./..", "a//../..", "..ok/a"]
    df = table(spark, [(p,) for p in paths], "path string")
    got = {r.path for r in ru.safe_path(df, ["path"]).collect()}
    assert got == {"a/../../b", "../a", "a//../.."}


def test_parse_rate_of_many_digits(spark):
    df = table(spark, [("600000000000000000/200000000000000000",), ("832040000000/514229",), ("0/1",)], "r string")
    got = [r.x for r in df.select(clock.parse_rate("r").alias("x")).collect()]
    assert [tuple(x) if x else None for x in got] == [(3, 1), (832040000000, 514229), None]


def test_srt_patterns_are_searched_once_a_block(spark):
    """the timing pattern stood 16 times in the plan, each with a trim of its own."""
    df = table(spark, [(1, "1\n00:00:01,000 --> 00:00:02,000\na", 960_000)], "track_id long, text string, duration_samples long")
    plan = ly.srt_cues(df, KEY)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("(\\d{2,})") / 2 <= 2  # twice in the pattern


def test_trim_takes_both_ends_only(spark):
    """no pattern runs over the text, which took the square of the length of a run of blanks."""
    inner = "a" + " " * 300_000 + "b"
    df = table(spark, [(f"　\t\x1c{inner}  ",), ("​ x﻿",), (" ",), (None,)], "t string")
    assert [r.x for r in df.select(tx.trim(F.col("t")).alias("x")).collect()] == [inner, "​ x﻿", "", None]
    chars = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{tx.WHITE_CHARS}]", c))
    assert tx.WHITE_CHARS == "".join(c for c in chars) and all(c.isspace() for c in chars)


def test_srt_ends_are_stripped_as_the_import_says(spark):
    """Only marks, line ends and blanks go; a line separator behind them is text of the document."""
    got = _imported(spark, ly.srt_cues, ["﻿\n 1\n00:00:01,000 --> 00:00:02,000\none\n ﻿", "a\n "])
    assert got == [[(48_000, 96_000, "one")], ["invalid_lyric_timestamp"]]


def test_documents_are_dealt_out_before_they_are_parsed(spark):
    """a file of one row group was parsed in one task."""
    for name in ("srt_cues", "lrc_cues", "import_facts"):
        plan = all_queries()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == 1 and "documents.parquet" in plan, name


def test_evaluation_takes_as_many_tasks_as_its_rows_need(spark, monkeypatch):
    """F16: with a fixed number of tasks, the memory of one grew with the rows."""
    assert [blocks.tasks_for(n, spark, 500) for n in (0, 2000, 2001, 50_001)] == [4, 4, 5, 101]
    seen = []
    monkeypatch.setattr(ly, "tasks_for", lambda rows, session: seen.append(rows) or 7)
    refs = table(spark, [(1, k, 1000 * k) for k in range(15)] + [(2, 0, None), (3, 1, 7)], "track_id long, line long, reference_sample long")
    # The last line of track 1 is lost, one is there twice.
    lines = table(spark, [(1, k, 1000 * k + k if k < 14 else None) for k in range(15)] + [(1, 3, 3100), (2, 0, 5)],
                  "track_id long, line long, start_sample long")
    got = {r.track_id: tuple(r)[1:] for r in ly.evaluate(lines, refs, KEY).collect()}
    assert seen == [17] and got == {
        1: (16, 15, 1, 7, 13, False, None), 2: (1, 1, 0, None, None, False, "invalid_reference_points"),
        3: (1, 0, 1, None, None, False, "too_few_reference_points"),
    }


def test_short_files_are_shared_out_and_their_rows_batched(spark, tmp_path, monkeypatch):
    """all files of a few hundred bytes were one task, and each of their rows a batch of its own."""
    rng = np.random.default_rng(3)
    values = {f"{k:02d}.wav": rng.integers(-(1 << 23), 1 << 23, 64) for k in range(10)}
    for name, samples in values.items():
        _wav_file(tmp_path / name, samples)
    _wav_file(tmp_path / "99.wav", [1], width=2)
    monkeypatch.setattr(pcm, "SPLIT_RANGES", 4)
    monkeypatch.setattr(pcm, "BATCH_ROWS", 10)
    reader = pcm.PcmReader({"path": str(tmp_path), "block": "24"})
    parts = reader.partitions()
    batches = [list(reader.read(p)) for p in parts]
    assert [len(p.parts) for p in parts] == [4, 4, 3] and [[b.num_rows for b in x] for x in batches] == [[10, 2], [10, 2], [7]]
    rows = [r for x in batches for b in x for r in b.to_pylist()]
    for name, samples in values.items():
        own = [r for r in rows if r["path"].endswith(name)]
        assert [r["block_idx"] for r in own] == [0, 1, 2] and [len(r["samples"]) for r in own] == [24, 24, 16]
        assert np.array_equal(np.concatenate([r["samples"] for r in own]) * (1 << 23), samples)
    assert [(r["reason"], r["samples"]) for r in rows if r["path"].endswith("99.wav")] == [("not_24_bit", None)]
    monkeypatch.setattr(pcm, "BATCH_SAMPLES", 48)
    assert [b.num_rows for b in reader.read(parts[0])][:2] == [2, 3]


def test_documents_without_a_sentence_make_no_srt_document(spark, tmp_path):
    """they came out as invalid_srt_block; the SQL has no row of them."""
    texts = ["", None, "...", " .\n. \n", "One. [Two].\n\n 3 ", "[Only]", ". a ."]
    rows = list(enumerate(texts, 1))
    table(spark, rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    queries, sql = all_queries()
    got = queries["srt_cues"](spark, str(tmp_path)).select("doc_id", "cue_idx", "start_sample", "end_sample", "text", "reason")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(sql["srt_cues"]).fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got.collect()) == order(want) and {r[0] for r in want} == {5, 6, 7}


def _grid_case(spark, tracks, hop, rate, fps):
    """Signals of two sources, routes on shared targets and spans of tracks of several lengths."""
    rng = random.Random(17)
    ends = table(spark, tracks, "track_id long, duration_samples long")
    levels, rows, spans = [], [], []
    for track, length in tracks:
        for source in ("a", "b"):
            n = max(1, length // hop - (3 if source == "b" else 0))
            rows += [(track, source, k, rng.random()) for k in range(n)]
        cuts = sorted({0, length, *(rng.randrange(length) for _ in range(6))})
        for k, (start, end) in enumerate(zip(cuts, cuts[1:])):
            layers = [
                (name, rng.random(), rng.random() < 0.7, {p: rng.random() for p in ("x", "y", "z") if rng.random() < 0.8})
                for name in ("orb", "orb.x", "ribbon") if rng.random() < 0.8
            ]
            spans.append((track, start, end, rng.choice([0, 40, 4000]), layers if k % 4 != 3 else None))
    numbers = {"min": 0.1, "max": 0.9, "threshold": 0.4, "low": -1.0, "high": 2.0, "attack_seconds": 0.5, "release_seconds": 2.0}
    routes = [
        (track, k, source, layer, name, kind, numbers if k % 2 else {"max": 1.5, "high": 1.0})
        for track, _ in tracks
        for k, (source, layer, name, kind) in enumerate([
            ("a", "orb", "x", "linear"), ("b", "orb", "y", "smooth"), ("a", "ribbon", "x", "threshold"), ("b", "orb", "x", "linear"),
            ("a", "orb", "y", "smooth"), ("a", "ribbon", "x", "smooth"), ("missing", "orb", "z", "linear"), ("b", "orb", "none", "smooth"),
        ]) if track != 3 or k < 2
    ]
    signals = table(spark, rows, "track_id long, source string, idx long, value double").cache()
    span_ddl = (
        "track_id long, start_sample long, end_sample long, transition_samples long, layers "
        "array<struct<layer_id:string,opacity:double,enabled:boolean,parameters:map<string,double>>>"
    )
    route_ddl = (
        "track_id long, route_idx int, source string, target_layer string, target_parameter string, transform string, "
        "params map<string,double>"
    )
    keys = ["track_id", "source"]
    grid = clock.frame_grid(ends.select("track_id", F.lit(0).cast("long").alias("start_sample"), F.col("duration_samples").alias("end_sample")),
                            rate, *fps).select("track_id", "frame", "sample")
    points = grid.crossJoin(table(spark, [("a",), ("b",)], "source string"))
    levels = sg.sample_signal(signals, points, keys, hop, 8)
    sources = ends.crossJoin(table(spark, [("a",), ("b",)], "source string"))
    packed = sg.sample_grid(signals, sources, keys, hop, 8, 16, rate, *fps)
    return ends, grid, levels, packed, table(spark, routes, route_ddl), table(spark, spans, span_ddl)


def _shown(df, names):
    return sorted(
        (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=str
    )


@pytest.mark.parametrize("hop, rate, fps", [(1000, 1000, (30000, 1001)), (10, 1000, (7, 2))])
def test_blocks_of_frames_equal_the_rows(spark, hop, rate, fps):
    """levels, routes and parameters made in place are those of the joins on frames."""
    case = _grid_case(spark, [(1, 5_001), (2, 999), (3, 2_000), (4, 40)], hop, rate, fps)
    ends, grid, levels, packed, routes, spans = case
    names = ["track_id", "source", "frame", "level"]
    unpacked = packed.select("track_id", "source", "first_frame", F.posexplode("levels").alias("at", "level"))
    assert _shown(levels, names) == _shown(unpacked.withColumn("frame", F.col("first_frame") + F.col("at")), names)
    blocks_of = rs.route_blocks(packed, routes, KEY, 1 / 8).cache()
    rows = rs.route_values(levels, routes, KEY, 1 / 8, 16).cache()
    names = ["track_id", "route_idx", "frame", "target_layer", "target_parameter", "value"]
    assert _shown(rows, names) == _shown(rs.route_rows(blocks_of, KEY), names)
    names.remove("route_idx")
    last = rs.route_rows(rs.dedupe_blocks(blocks_of), KEY)
    assert _shown(rs.dedupe_routes(rows, KEY), names) == _shown(last, names)
    names = ["track_id", "frame", "sample", "layer_id", "parameter", "value", "opacity", "enabled"]
    want = _shown(rs.frame_params(grid, spans, rows, KEY, 700), names)
    assert want and want == _shown(rs.grid_params(spans, ends, blocks_of, KEY, 700, 16, rate, *fps), names)


def test_frames_are_made_after_the_last_exchange(spark):
    """every frame was moved up to four times, each with its routes, and sorted."""
    for name in ("dedupe_routes", "frame_params", "smooth_route", "route_target"):
        plan = all_queries()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in plan.splitlines() if "Exchange" in x or "Sort " in x]
        assert moved and not [x for x in moved if re.search(r"\bframe#", x)], name
