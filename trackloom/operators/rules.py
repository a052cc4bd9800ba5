"""Data quality rules. Each gives one row per violation: rule, the key columns, detail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.blocks import int_div, neighbour, ordinal, salted_join

# Closed output profiles (width, height, fps numerator, fps denominator).
PROFILES = ((1920, 1080, 30, 1), (1080, 1920, 30, 1))
NAME = "^[a-zA-Z0-9_.-]+$"
SHA256 = "^[a-f0-9]{64}$"


def violations(df: DataFrame, rule: str, keys: Sequence[str], bad: Column, detail) -> DataFrame:
    """Rows where ``bad`` holds; an unknown (null) result does not violate."""
    return df.where(F.coalesce(bad, F.lit(False))).select(
        F.lit(rule).alias("rule"), *keys, detail.cast("string").alias("detail")
    )


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return violations(counts, "unique_key", keys, F.col("_n") > 1, F.col("_n"))


def _with_before(df: DataFrame, keys: Sequence[str], block: int, index: str | None = None) -> DataFrame:
    order = ["start_sample", "end_sample"] if index is None else [index]
    return neighbour(df, keys, order, int_div(order[0], block), ["end_sample"], "_before", -1)


def ordered_ranges(df: DataFrame, keys: Sequence[str], block: int, index: str | None = None) -> DataFrame:
    """Ranges of a parent must not overlap.

    With ``index``, the place of a range in its list, each range must also lie behind the
    one before it in the list, so ranges out of order are violations too.
    """
    return violations(
        _with_before(df, keys, block, index), "overlapping_range", [*keys, "start_sample"],
        F.col("_before.end_sample") > F.col("start_sample"), F.col("_before.end_sample"),
    )


def contiguous_ranges(df: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Each range starts where the one before it ends."""
    return violations(
        _with_before(df, keys, block), "gap_or_overlap", [*keys, "start_sample"],
        F.col("_before.end_sample") != F.col("start_sample"), F.col("_before.end_sample"),
    )


def full_cover(df: DataFrame, tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges start at 0 and end at the end of the track."""
    edges = df.groupBy(*keys).agg(
        F.min("start_sample").alias("_first"), F.max("end_sample").alias("_last")
    )
    rows = tracks.select(*keys, "duration_samples").join(edges, list(keys), "left")
    bad = ~(F.col("_first").eqNullSafe(F.lit(0)) & F.col("_last").eqNullSafe(F.col("duration_samples")))
    return violations(
        rows, "incomplete_cover", keys, bad,
        F.concat_ws("-", F.coalesce("_first", F.lit(-1)), F.coalesce("_last", F.lit(-1))),
    )


def inside_track(
    df: DataFrame, tracks: DataFrame, keys: Sequence[str], track: Sequence[str] = ("track_id",)
) -> DataFrame:
    rows = salted_join(df, tracks.select(*track, "duration_samples"), list(track), "left")
    bad = (
        F.col("duration_samples").isNull()
        | (F.col("start_sample") < 0)
        | (F.col("end_sample") > F.col("duration_samples"))
    )
    return violations(rows, "out_of_track", keys, bad, F.col("end_sample"))


def domain(df: DataFrame, keys: Sequence[str], checks: dict[str, Column]) -> DataFrame:
    """Several value checks in one pass: code -> condition that must hold."""
    found = F.filter(
        F.array(
            *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items()]
        ),
        lambda c: c.isNotNull(),
    )
    return df.select(
        F.lit("domain").alias("rule"), *keys, F.explode(found).alias("detail")
    )


def conditional_presence(
    df: DataFrame, keys: Sequence[str], when: Column, present: Sequence[str], absent: Sequence[str]
) -> DataFrame:
    """Where ``when`` holds, some columns must be set and others must not."""
    wrong = [F.when(F.col(c).isNull(), F.lit(f"{c} required")) for c in present]
    wrong += [F.when(F.col(c).isNotNull(), F.lit(f"{c} forbidden")) for c in absent]
    return df.where(when).select(
        F.lit("presence").alias("rule"), *keys,
        F.explode(F.filter(F.array(*wrong), lambda c: c.isNotNull())).alias("detail"),
    )


def required_keys(df: DataFrame, keys: Sequence[str], have: str, need: Column) -> DataFrame:
    """A key set must be exactly ``need``."""
    missing = F.transform(
        F.array_sort(F.array_except(need, have)), lambda k: F.concat(F.lit("-"), k)
    )
    extra = F.transform(
        F.array_sort(F.array_except(have, need)), lambda k: F.concat(F.lit("+"), k)
    )
    rows = df.withColumn("_diff", F.array_join(F.concat(missing, extra), ","))
    return violations(rows, "key_set", keys, F.col("_diff") != "", F.col("_diff"))


def unknown_reference(
    df: DataFrame,
    known: DataFrame,
    keys: Sequence[str],
    ref: str,
    target: str,
    parent: Sequence[str] = ("track_id",),
) -> DataFrame:
    """References to ids that their own parent does not have."""
    ids = known.select(*parent, F.col(target).alias(ref))
    lost = df.join(ids, [*parent, ref], "left_anti")
    return violations(lost, "unknown_reference", keys, F.col(ref).isNotNull(), F.col(ref))


def identity(df: DataFrame, keys: Sequence[str], declared: str, computed: str) -> DataFrame:
    """A declared number must equal the computed one."""
    bad = ~F.col(declared).eqNullSafe(F.col(computed))
    return violations(
        df, "arithmetic", keys, bad,
        F.concat_ws("<>", F.coalesce(F.col(declared).cast("string"), F.lit("null")),
                    F.coalesce(F.col(computed).cast("string"), F.lit("null"))),
    )


def strictly_increasing(
    df: DataFrame, parent: Sequence[str], order: str, value: str, block: int
) -> DataFrame:
    rows = neighbour(df, parent, [order], int_div(order, block), [value], "_before", -1)
    return violations(
        rows, "not_increasing", [*parent, order], F.col(f"_before.{value}") >= F.col(value),
        F.col(value),
    )


def anchored_edges(spans: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Span edges must equal the samples of their recorded anchors."""
    keys = list(keys)
    at = anchors.select(*keys, "anchor", "sample")
    rows = spans.join(
        at.withColumnsRenamed({"anchor": "start_anchor", "sample": "_from"}),
        [*keys, "start_anchor"], "left",
    ).join(
        at.withColumnsRenamed({"anchor": "end_anchor", "sample": "_to"}),
        [*keys, "end_anchor"], "left",
    )
    same = F.col("start_sample").eqNullSafe(F.col("_from")) & F.col("end_sample").eqNullSafe(
        F.col("_to")
    )
    return violations(
        rows, "edge_off_anchor", [*keys, "start_anchor"], ~same, F.col("start_sample")
    )


def content_hash(refs: DataFrame, inventory: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recorded hash against the inventory; a path that is not there is missing."""
    rows = salted_join(
        refs, inventory.select("path", F.col("sha256").alias("_actual")), ["path"], "left"
    )
    detail = F.when(F.col("_actual").isNull(), "missing_file").otherwise("hash_mismatch")
    return violations(
        rows, "content_hash", keys, ~F.col("_actual").eqNullSafe(F.col("sha256")), detail
    )


def path_alias(refs: DataFrame, resolved: Column) -> DataFrame:
    """Several references that resolve to one target."""
    counts = refs.groupBy(resolved.alias("target")).agg(F.count("*").alias("_n"))
    return violations(counts, "path_alias", ["target"], F.col("_n") > 1, F.col("_n"))


def safe_path(refs: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """Remote, absolute and escaping paths are forbidden; ``a/../b`` stays inside."""
    p = F.col(path)
    # Depth after each part; the root is left as soon as it is negative.
    step = lambda x: F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)
    walk = F.aggregate(
        F.split(p, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda a, x: F.struct(
            (a["depth"] + step(x)).alias("depth"),
            F.least(a["least"], a["depth"] + step(x)).alias("least"),
        ),
    )
    detail = (
        F.when(p.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), "remote_path")
        .when(p.startswith("/"), "absolute_path")
        .when(walk["least"] < 0, "escaping_path")
    )
    return violations(refs, "unsafe_path", keys, detail.isNotNull(), detail)


def closed_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    fields = ("width", "height", "fps_num", "fps_den")
    ok = F.lit(False)
    for profile in PROFILES:
        match = F.lit(True)
        for name, value in zip(fields, profile):
            match = match & (F.col(name) == value)
        ok = ok | match
    return violations(df, "unknown_profile", keys, ~ok, F.concat_ws("x", *fields))


def constant_rate(
    stamps: DataFrame, probes: DataFrame, keys: Sequence[str], block: int
) -> DataFrame:
    """Declared rate equals the average rate, and each frame is within one tick of i / fps.

    All in whole numbers: |t * tb_num * num - i * den * tb_den| <= tb_num * num.
    ``stamps``: keys, timestamp. ``probes``: keys, fps_*, avg_fps_*, tb_num, tb_den and,
    where it is to be compared with the number of timestamps, frame_count.
    """
    keys = list(keys)
    declared = violations(
        probes, "variable_rate", keys,
        (F.col("fps_num") != F.col("avg_fps_num")) | (F.col("fps_den") != F.col("avg_fps_den")),
        F.concat_ws("/", "avg_fps_num", "avg_fps_den"),
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    rows = salted_join(
        ordinal(stamps, keys, ["timestamp"], int_div("timestamp", block), "_i"),
        probes.select(*keys, "fps_num", "fps_den", "tb_num", "tb_den"), keys,
    )
    off = F.abs(
        wide("timestamp") * wide("tb_num") * wide("fps_num")
        - wide("_i") * wide("fps_den") * wide("tb_den")
    )
    drift = violations(
        rows, "frame_off_grid", keys, off > wide("tb_num") * wide("fps_num"), F.col("_i")
    )
    out = declared.unionByName(drift)
    if "frame_count" in probes.columns:
        counts = stamps.groupBy(*keys).agg(F.count("*").alias("_stamps"))
        both = probes.select(*keys, "frame_count").join(counts, keys, "left")
        number = F.coalesce("_stamps", F.lit(0))
        out = out.unionByName(violations(both, "frame_count", keys, number != F.col("frame_count"), number))
    return out


def same_identity_set(
    df: DataFrame, parent: Sequence[str], span: str, member: str
) -> DataFrame:
    """All spans of a parent carry the same set of ids (a span's set is bounded by its layers)."""
    sets = df.groupBy(*parent, span).agg(
        F.array_join(F.array_sort(F.collect_set(member)), ",").alias("_ids")
    )
    ends = sets.groupBy(*parent).agg(F.min("_ids").alias("_a"), F.max("_ids").alias("_b"))
    return violations(
        ends, "identity_set", list(parent), F.col("_a") != F.col("_b"),
        F.concat_ws(" <> ", "_a", "_b"),
    )
