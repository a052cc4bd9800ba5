"""Ordered primitives against plain Python, with blocks so small that every border is crossed."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import blocks
from trackloom.functions.blocks import (
    int_div,
    neighbour,
    ordinal,
    owner_interval,
    running_sum,
    salted_join,
)
from trackloom.operators.resolve import _block_map, _composed_map, smooth
from trackloom.operators.signals import minimum_wait
from trackloom.operators.structure import select_repeats


@pytest.fixture(scope="module")
def points():
    rng = random.Random(5)
    return sorted((t, s) for t in range(2) for s in rng.sample(range(400), 60))


def test_neighbour_and_running(spark, points):
    df = spark.createDataFrame(points, "track_id long, sample long")
    cut = int_div("sample", 23)
    got = neighbour(df, ["track_id"], ["sample"], cut, ["sample"], "p", -1)
    got = neighbour(got, ["track_id"], ["sample"], cut, ["sample"], "n", 1)
    got = ordinal(got, ["track_id"], ["sample"], cut, "k")
    got = running_sum(got, ["track_id"], ["sample"], cut, F.col("sample"), "upto")
    rows = {
        (r.track_id, r.sample): (r.p and r.p.sample, r.n and r.n.sample, r.k, r.upto)
        for r in got.collect()
    }
    for t in range(2):
        mine = [s for k, s in points if k == t]
        for i, s in enumerate(mine):
            want = (
                mine[i - 1] if i else None,
                mine[i + 1] if i + 1 < len(mine) else None,
                i,
                sum(mine[: i + 1]),
            )
            assert rows[(t, s)] == want


def test_owner_interval_is_half_open(spark):
    intervals = spark.createDataFrame(
        [(1, 0, 10, "a"), (1, 10, 95, "b"), (1, 120, 130, "c")],
        "track_id long, start_sample long, end_sample long, id string",
    )
    at = spark.createDataFrame([(1, s) for s in range(140)], "track_id long, sample long")
    got = owner_interval(at, intervals, ["track_id"], "sample", ["id"], 16)
    found = {r.sample: r.owner.id if r.owner else None for r in got.collect()}
    for s in range(140):
        want = "a" if s < 10 else "b" if s < 95 else "c" if 120 <= s < 130 else None
        assert found[s] == want


def test_salted_join_keeps_left_rows(spark):
    big = spark.createDataFrame([(i % 2, i) for i in range(50)], "k long, v long")
    small = spark.createDataFrame([(0, "x")], "k long, name string")
    assert salted_join(big, small, ["k"]).count() == 25
    left = salted_join(big, small, ["k"], "left")
    assert left.count() == 50 and left.where("name is null").count() == 25


def test_salted_copies_are_never_broadcast(spark):
    big = spark.range(1000).selectExpr("id % 7 as k", "id as v")
    small = spark.range(7).selectExpr("id as k", "cast(id as string) as name")
    for how in ("inner", "left"):
        joined = salted_join(big, small, ["k"], how)
        assert joined.count() == 1000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def _loop(targets, attack, release, delta):
    import math

    out, state = [], targets[0]
    for x in targets:
        seconds = attack if x > state else release
        state = x if seconds <= 0 else state + (x - state) * (1 - math.exp(-delta / seconds))
        out.append(state)
    return out


@pytest.mark.parametrize(
    "attack,release,block,fan",
    [(2.0, 8.0, 7, 64), (0.0, 300.0, 16, 2), (500.0, 900.0, 33, 64), (40.0, 0.0, 3, 3), (700.0, 400.0, 5, 2)],
)
def test_smoother_equals_the_plain_loop(spark, attack, release, block, fan):
    rng = random.Random(3)
    series = {k: [rng.random() for _ in range(100)] for k in range(3)}
    series[9] = [0.5] * 100
    rows = [(k, i, x, attack, release) for k, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(
        rows, "k long, frame long, target double, attack_seconds double, release_seconds double"
    )
    got = {(r.k, r.frame): r.value for r in smooth(df, ["k"], 1.0, block, fan).collect()}
    assert len(got) == len(rows)
    for k, xs in series.items():
        for i, want in enumerate(_loop(xs, attack, release, 1.0)):
            assert got[(k, i)] == pytest.approx(want, abs=1e-9)


def test_maps_compose_like_functions():
    rng = np.random.default_rng(6)
    for _ in range(200):
        up, down = rng.choice([0.0, 0.3, 0.97], 2)
        one, two = rng.random(rng.integers(1, 6)).tolist(), rng.random(rng.integers(1, 6)).tolist()
        f, g = _block_map(one, 0.0, 1.0, up, down), _block_map(two, 0.0, 1.0, up, down)
        both = _composed_map(*f, *g)
        for p in np.linspace(0, 1, 60):
            state = p
            for x in one + two:
                state = x + (state - x) * (up if x > state else down)
            assert np.interp(p, *both) == pytest.approx(state, abs=1e-12)


def test_no_row_holds_a_whole_track(spark, monkeypatch):
    """With 200 blocks and a fan-in of 4, composed and handed-down rows have four links at most."""
    rows = [(1, i, float(i * 7919 % 101), 3.0, 5.0) for i in range(400)]
    df = spark.createDataFrame(
        rows, "k long, frame long, target double, attack_seconds double, release_seconds double"
    )
    written, keep = [], blocks.materialize
    monkeypatch.setattr(blocks, "materialize", lambda d: written.append(keep(d)) or written[-1])
    assert smooth(df, ["k"], 1.0, 2, 4).count() == 400
    packed, *levels = written
    assert packed.count() == 200 and [w.count() for w in levels] == [200, 50, 13, 4]


@pytest.mark.parametrize("fan", [64, 2])
def test_minimum_wait_equals_greedy(spark, fan, monkeypatch):
    monkeypatch.setattr(blocks.blocked_fold, "__defaults__", (None, fan))
    rng = random.Random(11)
    peaks = {k: sorted(rng.sample(range(200), 90)) for k in range(2)}
    peaks[2] = [0, 2, 60, 61, 65, 190, 191]
    df = spark.createDataFrame([(k, i) for k, xs in peaks.items() for i in xs], "k long, idx long")
    got = minimum_wait(df, ["k"], 3, 8)
    for k, xs in peaks.items():
        want, last = [], None
        for i in xs:
            if last is None or i > last + 3:
                want.append(i)
                last = i
        assert sorted(r.idx for r in got.where(f"k = {k}").collect()) == want


def test_select_repeats_equals_greedy_over_all(spark):
    rng = random.Random(2)
    rows = [
        (t, a, a + 3 + b, rng.choice([3, 4, 5]), round(rng.choice([0.9, 0.95, rng.random()]), 9))
        for t in range(2) for a in range(12) for b in range(40)
    ]
    df = spark.createDataFrame(
        rows, "track_id long, left long, right long, length long, score double"
    )
    got = select_repeats(df, ["track_id"]).collect()
    for t in range(2):
        chosen = []
        for c in sorted((r[1:] for r in rows if r[0] == t), key=lambda c: (-c[2], -c[3], c[0], c[1])):
            spans = {(c[0], c[2]), (c[1], c[2])}
            if len(chosen) < 8 and not any(spans & {(d[0], d[2]), (d[1], d[2])} for d in chosen):
                chosen.append(c)
        mine = [(r.left, r.right, r.length, r.score) for r in got if r.track_id == t]
        assert sorted(mine) == sorted(chosen)
