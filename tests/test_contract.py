"""The driver's contract, and metamorphic checks on the flagship."""

import re
import sys

import __spark_entry__ as entry
from pyspark.sql import functions as F

from trackloom.plans import all_queries
from trackloom.plans import resolve_queries as rq
from trackloom.plans import signals_queries as sq
from trackloom.plans import views as v
from trackloom.plans.registry import Tables
from trackloom.operators import resolve as rs

ROOT = "/root/testdata/sf0.001"


def test_queries_and_sql_have_the_same_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    queries, sql = all_queries()
    assert set(queries) <= set(entry.queries())
    assert set(queries) == set(sql)
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in queries)


def test_queries_remain_when_an_optional_package_is_missing(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("trackloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tokenizers", None)
    monkeypatch.delattr("trackloom.llm", raising=False)
    assert set(entry.queries()) == set(all_queries()[0]) and set(entry.oracle_sql()) == set(all_queries()[1])


def test_smoothing_does_not_depend_on_blocks_and_excerpts(spark):
    t = Tables(spark, ROOT)
    levels = t.shared("levels", rq.levels)
    routes = rq.routes(t)
    one = rs.route_values(levels, routes, ["track_id"], rq.DELTA, 64)
    two = rs.route_values(levels.repartition(3), routes, ["track_id"], rq.DELTA, 1000)
    names = ["track_id", "route_idx", "frame", F.round("value", 9).alias("value")]
    # A frame range is cut after smoothing, so it equals the same rows of the full run.
    cut = F.col("frame").between(300, 330)
    a = sorted(map(tuple, one.where(cut).select(*names).collect()))
    b = sorted(map(tuple, two.select(*names).where(cut).collect()))
    assert a and a == b
    assert v.HOPS == 120


def test_plans_have_no_cross_join_and_no_single_task(spark):
    queries = entry.queries()
    for name in (
        "hop_rms", "sync_mean", "sample_signal", "fill_gaps", "owner_span", "active_cue",
        "rule_ordered_ranges", "cache_key", "compare_variants", "union_length", "evaluate",
    ):
        plan = queries[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
        for shape in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
            assert shape not in plan, (name, shape)


def test_the_grid_of_the_bands_is_not_moved(spark, tmp_path):
    """grid, joined bands and envelope were shuffled one after the other, 600 rows a track each time."""
    rows = [
        (1, "2024-01-01 00:00:01", 5, "click", 1.5), (2, "2024-01-01 00:00:02", 5, "click", 2.0),
        (3, "2024-01-30 23:00:00", 5, "view", None), (4, "2024-01-02 00:00:00", 6, "other", 3.0),
        (5, "2024-02-02 00:00:00", 7, "view", 4.0), (6, "2024-01-01 06:00:00", None, "view", 4.0),
    ]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    ).write.parquet(str(tmp_path / "events.parquet"))
    bands = v.band_signals(Tables(spark, str(tmp_path)))
    got = [tuple(r) for r in bands.select("track_id", "name", "idx", "value").collect()]
    assert len(got) == len({r[:3] for r in got}) == 4 * 5 * v.HOPS
    assert [r for r in got if r[3] != 0] == [(5, "click", 0, 350.0)]
    assert {r[0] for r in got} == {5, 6, 7, None}
    plan = sq.make_envelope(Tables(spark, ROOT))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
