"""Variant comparison and media checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.blocks import (
    halo_window,
    home_rows,
    int_div,
    neighbour,
    ordinal,
    salted_join,
    with_halo,
)
from trackloom.operators.lyrics import rank_values

# Fixed value: longest edge of a review thumbnail.
THUMBNAIL = 480


def compare_variants(
    clips: DataFrame, keys: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Fields in which a variant's clip differs from the first variant's clip of the same range.

    ``clips``: keys, range_idx, variant_idx and ``fields``.
    """
    group = [*keys, "range_idx"]
    first = clips.groupBy(*group).agg(
        F.min_by(F.struct(*fields), "variant_idx").alias("_first")
    )
    wrong = F.array(
        *[F.when(~F.col(f).eqNullSafe(F.col(f"_first.{f}")), F.lit(f)) for f in fields]
    )
    # A range has one row per variant: nothing to salt, and the copies would outweigh the clips.
    return clips.join(first.hint("merge"), group).select(
        *group, "variant_idx", F.explode(F.filter(wrong, lambda c: c.isNotNull())).alias("field")
    )


def eligible(manifests: DataFrame, required: Sequence[str]) -> DataFrame:
    """Reason why a manifest may not be compared, null when it may."""
    missing = F.array_except(F.array(*[F.lit(k) for k in required]), F.map_keys("inputs"))
    extra = F.col("outputs") - F.col("ranges")
    reason = (
        F.when(F.col("status") != "completed", "incomplete")
        .when(F.col("audio_sha256").isNull(), "source_missing")
        .when(F.size(missing) > 0, "inputs_missing")
        .when(~extra.isin(0, 1), "outputs_invalid")
    )
    return manifests.withColumn("reason", reason)


def reel_order(clips: DataFrame, keys: Sequence[str], block: int = 4096) -> DataFrame:
    """Play position of each clip: by range, then by variant; and the frames of the whole reel."""
    keys = list(keys)
    rows = ordinal(
        clips, keys, ["range_idx", "variant_idx"], int_div("range_idx", block), "position"
    )
    total = clips.groupBy(*keys).agg(F.sum("frames").alias("reel_frames"))
    return salted_join(rows, total, keys)


def midpoint_frame(frames: Column) -> Column:
    return int_div(frames, 2)


def thumbnail_size(width: Column, height: Column, longest: int = THUMBNAIL) -> Column:
    """struct(width, height): longest edge fixed, the other half-even and at least 1."""
    other = lambda a, b: F.greatest(
        F.lit(1).cast("long"), F.bround(F.lit(float(longest)) * a / b, 0).cast("long")
    )
    edge = F.lit(longest).cast("long")
    wide = F.struct(edge.alias("width"), other(height, width).alias("height"))
    tall = F.struct(other(width, height).alias("width"), edge.alias("height"))
    return F.when(width >= height, wide).otherwise(tall)


def signature(facts: str, ignored: Sequence[str]) -> Column:
    """Hash of a fact map without the ignored names, independent of map order."""
    kept = F.map_filter(facts, lambda k, _: ~k.isin(*ignored))

    def part(text: Column) -> Column:  # with its length, so that no two maps read the same
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    pairs = F.transform(
        F.array_sort(F.map_entries(kept)), lambda e: F.concat(part(e["key"]), part(e["value"]))
    )
    return F.sha2(F.array_join(pairs, ""), 256)


def bundle(parts: DataFrame, keys: Sequence[str], fields: Sequence[str], block: int) -> DataFrame:
    """Parts in range order with stable ids, and what keeps them from one bundle."""
    keys = list(keys)
    order = ["start_sample", "end_sample"]
    cut = int_div("start_sample", block)
    first = parts.groupBy(*keys).agg(
        F.min_by(F.struct(*fields), F.struct(*order)).alias("_first")
    )
    rows = salted_join(
        neighbour(ordinal(parts, keys, order, cut, "_n"), keys, order, cut, ["end_sample"],
                  "_before", -1),
        first, keys,
    )
    differs = F.lit(False)
    for field in fields:
        differs = differs | ~F.col(field).eqNullSafe(F.col(f"_first.{field}"))
    reason = F.when(differs, "identity_mismatch").when(
        F.col("start_sample") < F.col("_before.end_sample"), "overlapping_part"
    )
    return rows.select(
        *keys, F.format_string("provider-%02d", F.col("_n") + 1).alias("part_id"), *order,
        reason.alias("reason"),
    )


def diff_metrics(pairs: DataFrame, keys: Sequence[str], a: str, b: str, peak: float) -> DataFrame:
    """Mean and maximum |a-b|, changed share count and PSNR of two aligned arrays."""
    delta = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    total = F.aggregate("_d", F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate("_d", F.lit(0.0), lambda s, x: s + x * x)
    n = F.size("_d")
    mse = F.col("_sq") / n
    return (
        pairs.withColumn("_d", F.transform(delta, lambda x: x.cast("double")))
        .withColumn("_sq", squares)
        .select(
            *keys,
            (total / n).alias("mean_abs"),
            F.array_max("_d").alias("max_abs"),
            F.size(F.filter("_d", lambda x: x > 0)).cast("long").alias("changed"),
            F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse)).alias("psnr_db"),
        )
    )


def difference_gate(mean_abs: Column, max_abs: Column, mean_limit: float, max_limit: float) -> Column:
    return (mean_abs <= mean_limit) & (max_abs <= max_limit)


def spikes(series: DataFrame, keys: Sequence[str], margin: float, block: int) -> DataFrame:
    """Values that exceed both neighbours by a margin."""
    rows = with_halo(series, "idx", block, before=1, after=1)
    w = halo_window(keys, "idx")
    high = (F.col("value") > F.lag("value").over(w) + margin) & (
        F.col("value") > F.lead("value").over(w) + margin
    )
    return home_rows(rows.withColumn("_spike", F.coalesce(high, F.lit(False)))).where(
        "_spike"
    ).drop("_spike")


def sync_error(
    events: DataFrame, signal: DataFrame, keys: Sequence[str], event_key: Sequence[str],
    hop: int, window: int,
) -> DataFrame:
    """Hops from each event to the strongest |signal| within ``window`` hops, the earliest on a tie.

    Each event asks for its 2 * window + 1 hops by equi-join.
    """
    asked = events.withColumn("_at", int_div("sample", hop)).withColumn(
        "idx",
        F.explode(
            F.sequence(F.greatest(F.lit(0).cast("long"), F.col("_at") - window), F.col("_at") + window)
        ),
    )
    rank = F.struct(F.abs("value").alias("v"), (-F.col("idx")).alias("i"))
    return (
        asked.join(signal.select(*keys, "idx", "value"), [*keys, "idx"])
        .groupBy(*event_key, "_at")
        .agg(F.max_by("idx", rank).alias("_best"))
        .select(*event_key, (F.col("_best") - F.col("_at")).alias("offset_hops"))
    )


def union_length(ranges: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Samples covered by at least one range; overlap counts once.

    Ranges are cut at block borders, so each block adds up on its own.
    """
    cut = ranges.where("end_sample > start_sample").withColumn(
        "_block",
        F.explode(
            F.sequence(int_div("start_sample", block), int_div(F.col("end_sample") - 1, block))
        ),
    )
    pieces = cut.select(
        *keys, "_block",
        F.greatest("start_sample", F.col("_block") * block).alias("_from"),
        F.least("end_sample", (F.col("_block") + 1) * block).alias("_to"),
    )
    w = (
        Window.partitionBy(*keys, "_block")
        .orderBy("_from", "_to")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = F.coalesce(F.max("_to").over(w), F.col("_from"))
    gain = F.greatest(F.lit(0).cast("long"), F.col("_to") - F.greatest(F.col("_from"), seen))
    return (
        pieces.withColumn("_gain", gain)
        .groupBy(*keys)
        .agg(F.sum("_gain").alias("covered_samples"))
    )


def tail_frames(df: DataFrame, base: str, part: str) -> DataFrame:
    """A part may lack at most one frame, which is then held."""
    gap = F.col(base) - F.col(part)
    return df.withColumns(
        {
            "held_frames": F.when(gap.isin(0, 1), gap),
            "reason": F.when(~gap.isin(0, 1), "frame_count_mismatch"),
        }
    )


def run_stats(runs: DataFrame, keys: Sequence[str], elapsed: str, block: int = 4096) -> DataFrame:
    """Count, mean, extremes and exact median and P90 of whole-number run times."""
    base = runs.groupBy(*keys).agg(
        F.avg(elapsed).alias("mean"), F.min(elapsed).alias("shortest"),
        F.max(elapsed).alias("longest"),
    )
    return base.join(rank_values(runs, keys, elapsed, block), list(keys))
