"""Structure mining: beat cells, self-similarity, novelty boundaries, repeats, sections."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.blocks import (
    halo_window,
    home_rows,
    int_div,
    neighbour,
    ordinal,
    owner_interval,
    salted_join,
    spread,
    with_halo,
)
from trackloom.operators.signals import SILENCE, diff_novelty
from trackloom.sources.tables import materialize

# Thresholds of the structure analysis.
NOVELTY_WINDOW = 4
NOVELTY_THRESHOLD = 0.12
ENERGY_WEIGHT = 0.25
REPEAT_SIMILARITY = 0.86
MIN_REPEAT = 3
MAX_REPEAT = 16
MAX_GROUPS = 8
MAX_AUTO_BOUNDARIES = 8
# Scores that differ by less are ties: sums of doubles vary with their order.
SCORE_DIGITS = 9
TILE = 128
#: Cells of one side of a task of the self-similarity: a task returns at most the square of this in rows.
TASK_CELLS = 1024
#: Pivots of a track: their vectors travel with every pack of cells, and four times as many are drawn.
MAX_PIVOTS = 256


def anchors(
    beats: DataFrame, tracks: DataFrame, keys: Sequence[str], block: int
) -> DataFrame:
    """Track endpoints and distinct interior beats, numbered from 0 in time order."""
    lengths = tracks.select(*keys, "duration_samples")
    inside = (
        salted_join(beats.select(*keys, "sample"), lengths, keys)
        .where("sample > 0 and sample < duration_samples")
        .select(*keys, "sample")
    )
    ends = lengths.select(
        *keys, F.explode(F.array(F.lit(0).cast("long"), "duration_samples")).alias("sample")
    )
    return ordinal(
        inside.unionByName(ends).distinct(), keys, ["sample"], int_div("sample", block), "anchor"
    )


def anchor_cells(marks: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Half-open cells between neighbouring anchors."""
    following = neighbour(
        marks, keys, ["sample"], int_div("sample", block), ["sample"], "_next", 1
    )
    return following.where("_next is not null").select(
        *keys,
        F.col("anchor").alias("cell"),
        F.col("sample").alias("start_sample"),
        F.col("_next.sample").alias("end_sample"),
    )


def sync_mean(
    signals: DataFrame, cells: DataFrame, keys: Sequence[str], block: int
) -> DataFrame:
    """Mean of the hop values inside each cell; a cell without hops is 0, not null."""
    owned = owner_interval(
        signals.select(*keys, "sample", "value"), cells, keys, "sample", ["cell"], block
    )
    means = (
        owned.where("owner is not null")
        .groupBy(*keys, F.col("owner.cell").alias("cell"))
        .agg(F.avg("value").alias("value"))
    )
    return cells.join(means, [*keys, "cell"], "left").withColumn(
        "value", F.coalesce("value", F.lit(0.0))
    )


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def cell_features(cells: DataFrame) -> DataFrame:
    """L2-normalized vector, then 0.5 energy appended, then normalized again; silence is 0."""
    n1 = _norm(F.col("vector"))
    unit = F.when(
        n1 > SILENCE, F.transform("vector", lambda x: x / F.col("_n1"))
    ).otherwise(F.col("vector"))
    joined = (
        cells.withColumn("_n1", n1)
        .withColumn("_joined", F.concat(unit, F.array(F.col("energy") * 0.5)))
        .withColumn("_n2", _norm(F.col("_joined")))
    )
    feature = F.when(
        F.col("_n2") > SILENCE, F.transform("_joined", lambda x: x / F.col("_n2"))
    ).otherwise(F.transform("_joined", lambda x: F.lit(0.0)))
    return joined.withColumn("feature", feature).drop("_n1", "_n2", "_joined")


def pivot_tiles(features: DataFrame, keys: Sequence[str], tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(tiles, pivots): the cells of each track grouped by their nearest pivot, and the pivots.

    Pivots are cells of the track: of cells drawn by hash, those far apart, about one for
    each ``tile`` cells and about ``MAX_PIVOTS`` at most. A group of more than ``tile`` cells is divided by cell number, so
    a tile holds about ``tile`` cells even where a third of a track is one vector.

    ``tiles``: keys, _pivot, _sub, _cells, _ball (centre and radius). ``pivots``: keys,
    _pivots (vectors), _reach (largest distance in each pivot's group).
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in features.schema}
    key_ddl = ", ".join(f"{k} {types[k]}" for k in keys)
    counts = features.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("cell").alias("_base"))
    wanted = F.least(F.lit(MAX_PIVOTS), F.ceil(F.col("_n") / tile)).cast("long") * 4
    spaced = salted_join(features, counts.withColumn("_stride", F.ceil(F.col("_n") / wanted)), keys)
    chosen = (
        spaced.where((F.col("cell") == F.col("_base")) | (F.pmod(F.xxhash64("cell"), "_stride") == 0))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("cell", "feature"))).alias("_p"))
        .select(*keys, F.col("_p.feature").alias("_pivots"))
    )

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of the drawn cells a quarter, each as far as possible from those before it, so that groups are tight."""
        for batch in batches:
            out = []
            for drawn in batch["_pivots"]:
                data = np.stack(drawn)
                picked, far = [0], ((data - data[0]) ** 2).sum(axis=1)
                while len(picked) * 4 < len(data) and far.max() > 0:
                    picked.append(int(far.argmax()))
                    far = np.minimum(far, ((data - data[picked[-1]]) ** 2).sum(axis=1))
                out.append(list(data[picked]))
            yield batch[keys].assign(_pivots=out)

    chosen = chosen.mapInPandas(apart, f"{key_ddl}, _pivots array<array<double>>")
    packs = features.groupBy(*keys, int_div("cell", tile).alias("_pack")).agg(
        F.collect_list(F.struct("cell", "feature", (F.col("energy") > SILENCE).alias("loud"))).alias("_cells")
    )

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                cells = batch["_cells"].iloc[i]
                data, pivots = np.stack([c["feature"] for c in cells]), np.stack(batch["_pivots"].iloc[i])
                far = np.maximum(
                    (data**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * data @ pivots.T, 0.0
                )
                near = far.argmin(axis=1)
                yield pd.DataFrame(
                    {
                        **{k: batch[k].iloc[i] for k in keys},
                        "_pivot": near,
                        "_far": np.sqrt(far[np.arange(len(near)), near]),
                        "cell": [c["cell"] for c in cells],
                        "feature": list(data),
                        "loud": [bool(c["loud"]) for c in cells],
                    }
                )

    placed = salted_join(packs, chosen, keys).mapInPandas(
        assign, f"{key_ddl}, _pivot int, _far double, cell bigint, feature array<double>, loud boolean"
    )
    placed = materialize(placed)
    sizes = placed.groupBy(*keys, "_pivot").agg(
        F.count("*").alias("_size"), F.max("_far").alias("_reach")
    )
    sub = F.pmod("cell", F.ceil(F.col("_size") / tile)).cast("int")
    tiles = (
        salted_join(placed, sizes, [*keys, "_pivot"])
        .groupBy(*keys, "_pivot", sub.alias("_sub"))
        .agg(F.collect_list(F.struct("cell", "feature", "loud")).alias("_cells"))
    )

    @F.pandas_udf("struct<centre:array<double>,radius:double>")
    def ball(cells: pd.Series) -> pd.DataFrame:
        centres, radii = [], []
        for group in cells:
            data = np.stack([c["feature"] for c in group])
            centre = data.mean(axis=0)
            centres.append(centre)
            radii.append(float(np.sqrt(((data - centre) ** 2).sum(axis=1).max())))
        return pd.DataFrame({"centre": centres, "radius": radii})

    reaches = sizes.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_pivot", "_reach"))).alias("_reach")
    )
    return tiles.withColumn("_ball", ball("_cells")), chosen.join(reaches, keys)


def near_tiles(tiles: DataFrame, pivots: DataFrame, keys: Sequence[str], reach: float) -> DataFrame:
    """keys, _pivot_a, _sub_a, _pivot_b, _sub_b: tiles that may hold vectors within ``reach`` of each other.

    First pivot groups are ruled out by the distance of the pivots and the groups' reach,
    then their tiles, joined on the pivot, by their balls. Both bounds are triangle
    inequalities, so no pair of vectors is lost.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in tiles.schema}
    key_ddl = ", ".join(f"{k} {types[k]}" for k in keys)

    def allowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                points = np.stack(batch["_pivots"].iloc[i])
                reaches = dict(batch["_reach"].iloc[i])
                used = np.array(sorted(reaches))
                radius, points = np.array([reaches[p] for p in used]), points[used]
                far = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
                a, b = np.nonzero(far - radius[:, None] - radius[None, :] <= reach)
                keep = a <= b
                yield pd.DataFrame(
                    {**{k: batch[k].iloc[i] for k in keys}, "_pivot_a": used[a[keep]], "_pivot_b": used[b[keep]]}
                )

    groups = pivots.select(*keys, "_pivots", "_reach").mapInPandas(allowed, f"{key_ddl}, _pivot_a int, _pivot_b int")
    side = lambda x: tiles.select(
        *keys, F.col("_pivot").alias(f"_pivot_{x}"), F.col("_sub").alias(f"_sub_{x}"), F.col("_ball").alias(f"_ball_{x}")
    )
    square = F.aggregate(
        F.zip_with("_ball_a.centre", "_ball_b.centre", lambda x, y: (x - y) * (x - y)),
        F.lit(0.0), lambda a, x: a + x,
    )
    return (
        groups.join(side("a"), [*keys, "_pivot_a"])
        .join(side("b"), [*keys, "_pivot_b"])
        .where((F.col("_pivot_a") < F.col("_pivot_b")) | (F.col("_sub_a") <= F.col("_sub_b")))
        .where(F.sqrt(square) - F.col("_ball_a.radius") - F.col("_ball_b.radius") <= reach)
        .select(*keys, "_pivot_a", "_sub_a", "_pivot_b", "_sub_b")
    )


def self_similarity(
    features: DataFrame,
    keys: Sequence[str],
    minimum: float = REPEAT_SIMILARITY,
    tile: int = TILE,
) -> DataFrame:
    """Cells i < j of a track whose clipped cosine reaches ``minimum``.

    Every reader of the similarity matrix either needs a narrow band around the
    diagonal (``novelty`` reads it itself) or only entries over a threshold, so
    the matrix is never written out. Cells of unit length are grouped by their nearest
    pivot (``pivot_tiles``); only tiles that the triangle inequality cannot part meet
    (``near_tiles``), which loses nothing. A task multiplies the tiles that meet of two groups
    of about ``TASK_CELLS`` cells, so a long track spreads over many tasks, and each cell is
    moved once for every group that it meets.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in features.schema}
    key_ddl = ", ".join(f"{k} {types[k]}" for k in keys)
    reach = math.sqrt(max(0.0, 2 - 2 * minimum)) + 1e-6
    # Written first: pushed below it, the filter would compute every feature many times over.
    features = materialize(features.select(*keys, "cell", "feature", "energy"))
    # A silent cell has no direction: its similarity is 0 to all, and it would spoil the bounds.
    rows = features.where(F.exists("feature", lambda x: x != 0)) if minimum > 0 else features
    tiles, pivots = pivot_tiles(rows, keys, tile)
    numbers = ordinal(tiles.select(*keys, "_pivot", "_sub"), keys, ["_pivot", "_sub"], F.col("_pivot"), "_tile")
    tiles = materialize(tiles.join(numbers, [*keys, "_pivot", "_sub"]))
    # Zero vectors take part only where everything is near enough.
    near = near_tiles(tiles, pivots, keys, reach if minimum > 0 else math.inf)
    # Neighbouring tiles travel together: a tile is sent to a group of tiles once, not to each of them.
    side = lambda x: tiles.select(
        *keys, F.col("_pivot").alias(f"_pivot_{x}"), F.col("_sub").alias(f"_sub_{x}"), F.col("_tile").alias(f"_tile_{x}")
    )
    group = max(1, TASK_CELLS // tile)
    pairs = materialize(
        near.join(side("a"), [*keys, "_pivot_a", "_sub_a"])
        .join(side("b"), [*keys, "_pivot_b", "_sub_b"])
        .select(
            *keys, int_div("_tile_a", group).alias("_group_a"), int_div("_tile_b", group).alias("_group_b"),
            "_tile_a", "_tile_b",
        )
    )
    task = [*keys, "_group_a", "_group_b"]
    wanted = pairs.select(*task, F.explode(F.array("_tile_a", "_tile_b")).alias("_tile")).distinct()
    to = [f"_to_{c}" for c in task]
    sent = wanted.join(tiles.select(*keys, "_tile", "_cells"), [*keys, "_tile"]).select(
        *[F.col(c).alias(n) for c, n in zip(task, to, strict=True)], "_tile", "_cells"
    )

    def unpack(group):
        cell = np.array([c["cell"] for c in group])
        loud = np.array([bool(c["loud"]) for c in group])
        return cell, np.stack([c["feature"] for c in group]).astype(np.float64), loud

    def multiply(key, met: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        data = {n: unpack(cells) for n, cells in zip(held["_tile"], held["_cells"], strict=True)}
        found = []
        for one, others in met.groupby("_tile_a")["_tile_b"]:
            ci, fi, li = data[one]
            cj, fj, lj = (np.concatenate(part) for part in zip(*[data[n] for n in others], strict=True))
            same = np.repeat([n == one for n in others], [len(data[n][0]) for n in others])
            sim = np.clip(fi @ fj.T, 0.0, 1.0)
            a, b = np.nonzero((sim >= minimum) & (~same | (ci[:, None] < cj)))
            found.append((np.minimum(ci[a], cj[b]), np.maximum(ci[a], cj[b]), sim[a, b], li[a] | lj[b]))
        i, j, similarity, loud = (np.concatenate(part) for part in zip(*found, strict=True))
        return pd.DataFrame(
            {**dict(zip(keys, key, strict=False)), "i": i, "j": j, "similarity": similarity, "loud": loud},
            index=range(len(i)),
        )

    return spread(pairs, *task).groupBy(*task).cogroup(spread(sent, *to).groupBy(*to)).applyInPandas(
        multiply, f"{key_ddl}, i bigint, j bigint, similarity double, loud boolean"
    )


def novelty(features: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Block contrast around each cell border, 0.75, plus the energy jump, 0.25.

    Reads only the band of the matrix within the window: 8 vectors per row.
    """
    size = NOVELTY_WINDOW
    rows = with_halo(
        features.select(*keys, F.col("cell").alias("idx"), "feature", "energy"),
        "idx", block, before=size, after=size - 1,
    )
    w = halo_window(keys, "idx")

    @F.pandas_udf("double")
    def contrast(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.zeros(len(left))
        for k, (a, b) in enumerate(zip(left, right)):
            n = min(len(a), len(b))
            if n == 0:
                continue
            x = np.stack(a[len(a) - n:])
            y = np.stack(b[:n])
            within = np.clip(x @ x.T, 0, 1).mean() + np.clip(y @ y.T, 0, 1).mean()
            out[k] = max(0.0, within / 2 - np.clip(x @ y.T, 0, 1).mean())
        return pd.Series(out)

    near = rows.select(
        *keys, "idx", "_block", "_home",
        F.collect_list("feature").over(w.rangeBetween(-size, -1)).alias("_left"),
        F.collect_list("feature").over(w.rangeBetween(0, size - 1)).alias("_right"),
        F.abs(F.col("energy") - F.lag("energy").over(w)).alias("_jump"),
    )
    score = F.when(F.col("idx") == 0, 0.0).otherwise(
        F.greatest(
            F.lit(0.0),
            F.least(
                F.lit(1.0),
                (1 - ENERGY_WEIGHT) * contrast("_left", "_right")
                + ENERGY_WEIGHT * F.coalesce("_jump", F.lit(0.0)),
            ),
        )
    )
    return home_rows(near).select(*keys, "idx", F.round(score, SCORE_DIGITS).alias("score"))


def pick_peaks(
    scores: DataFrame, keys: Sequence[str], block: int, threshold: float = NOVELTY_THRESHOLD
) -> DataFrame:
    """Scores at the threshold or over it and not below either neighbour (plateaus all count)."""
    rows = with_halo(scores, "idx", block, before=1, after=1)
    w = halo_window(keys, "idx")
    before, after = F.lag("score").over(w), F.lead("score").over(w)
    peak = (
        (F.col("idx") > 0)
        & (F.col("score") >= threshold)
        & (F.col("score") >= before)
        & (after.isNull() | (F.col("score") >= after))
    )
    return home_rows(rows.withColumn("_peak", peak)).where("_peak").drop("_peak")


def repeat_candidates(
    similar: DataFrame, counts: DataFrame, keys: Sequence[str], block: int = 4096
) -> DataFrame:
    """Longest run on the diagonal from each (left, right), within the length limits.

    ``similar`` holds the pairs over the threshold, ``counts`` one ``cells`` per
    track. A run is at most 16 long, so each pair looks 16 cells ahead.
    """
    rows = similar.where(F.col("j") - F.col("i") >= MIN_REPEAT).withColumn(
        "_d", F.col("j") - F.col("i")
    ).withColumnRenamed("i", "idx")
    rows = with_halo(rows, "idx", block, after=MAX_REPEAT - 1)
    w = halo_window([*keys, "_d"], "idx").rangeBetween(0, MAX_REPEAT - 1)
    ahead = home_rows(
        rows.withColumn("_ahead", F.collect_list(F.struct("idx", "similarity", "loud")).over(w))
    )
    unbroken = F.filter("_ahead", lambda x, k: x["idx"] == F.col("idx") + k)
    limit = F.least(F.lit(MAX_REPEAT).cast("long"), "_d", F.col("cells") - F.col("j"))
    # Lone pairs, which are most, go before they are joined.
    long_enough = ahead.withColumn("_run", unbroken).drop("_ahead").where(F.size("_run") >= MIN_REPEAT)
    runs = (
        salted_join(long_enough, counts.select(*keys, "cells"), keys)
        .withColumn("length", F.least(F.size("_run").cast("long"), limit))
        .where(F.col("length") >= MIN_REPEAT)
        .withColumn("_run", F.slice("_run", F.lit(1), F.col("length").cast("int")))
        .where(F.exists("_run", lambda x: x["loud"]))
    )
    mean = F.aggregate("_run", F.lit(0.0), lambda a, x: a + x["similarity"]) / F.col("length")
    return runs.select(
        *keys,
        F.col("idx").alias("left"),
        F.col("j").alias("right"),
        "length",
        F.round(mean, SCORE_DIGITS).alias("score"),
    )


def select_repeats(candidates: DataFrame, keys: Sequence[str], k: int = MAX_GROUPS) -> DataFrame:
    """Greedy best ``k``; a candidate is dropped when one of its spans equals a chosen span.

    The list that one task walks is bounded and still exact. Before the last pick
    at most 2(k-1) spans are taken, so a pick is among the first 2(k-1)+1
    candidates of its left span and of its right span; after that cut at most
    2(k-1) * 2(2(k-1)+1) + k candidates can precede or be the last pick.
    """
    taken = 2 * (k - 1)
    total = taken * 2 * (taken + 1) + k
    rank = [F.desc("score"), F.asc("left"), F.asc("right")]
    by_left = Window.partitionBy(*keys, "length", "left").orderBy(*rank)
    by_right = Window.partitionBy(*keys, "length", "right").orderBy(*rank)
    best = Window.partitionBy(*keys).orderBy(F.desc("length"), *rank)
    # The two span cuts are independent: both ranks are taken over all candidates.
    few = (
        candidates.withColumn("_l", F.row_number().over(by_left))
        .withColumn("_r", F.row_number().over(by_right))
        .where((F.col("_l") <= taken + 1) & (F.col("_r") <= taken + 1))
        .drop("_l", "_r")
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= total)
    )
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "left", "right", "length", "score")))
    kind = "array<struct<_rank:int,left:bigint,right:bigint,length:bigint,score:double>>"

    def clash(chosen: Column, x: Column) -> Column:
        return F.exists(
            chosen,
            lambda c: (c["length"] == x["length"])
            & (
                c["left"].isin(x["left"], x["right"]) | c["right"].isin(x["left"], x["right"])
            ),
        )

    chosen = F.aggregate(
        "_all",
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) >= k) | clash(acc, x), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    order = F.array_sort(
        F.transform(
            chosen,
            lambda x: F.struct(
                x["left"].alias("left"), x["right"].alias("right"), x["length"].alias("length"),
                x["score"].alias("score"),
            ),
        )
    )
    return (
        few.groupBy(*keys)
        .agg(ordered.alias("_all"))
        .select(*keys, F.posexplode(order).alias("_g", "_c"))
        .select(
            *keys,
            F.format_string("repeat-%03d", F.col("_g") + 1).alias("group_id"),
            "_c.*",
        )
    )


def repeat_spans(repeats: DataFrame, marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two span rows per repeat group, with anchor numbers and samples."""
    def span(number: int, first: str) -> Column:
        return F.struct(
            F.concat("group_id", F.lit(f"-{number}")).alias("span_id"),
            F.col(first).alias("start_anchor"),
            (F.col(first) + F.col("length")).alias("end_anchor"),
        )

    rows = repeats.select(
        *keys, "group_id", F.col("score").alias("confidence"),
        F.explode(F.array(span(1, "left"), span(2, "right"))).alias("_s"),
    ).select(*keys, "group_id", "confidence", "_s.*")
    at = marks.select(*keys, "anchor", "sample")
    start = at.withColumnsRenamed({"anchor": "start_anchor", "sample": "start_sample"})
    end = at.withColumnsRenamed({"anchor": "end_anchor", "sample": "end_sample"})
    return rows.join(start, [*keys, "start_anchor"]).join(end, [*keys, "end_anchor"])


def merge_boundaries(
    peaks: DataFrame,
    spans: DataFrame,
    marks: DataFrame,
    tracks: DataFrame,
    keys: Sequence[str],
    block: int,
) -> DataFrame:
    """One boundary per sample: maximum confidence, sorted distinct sources, ids in time order.

    ``peaks`` come as (idx = anchor, score). A boundary has at most 1 + 8 sources.
    """
    from_peaks = peaks.join(
        marks.select(*keys, F.col("anchor").alias("idx"), "sample"), [*keys, "idx"]
    ).select(*keys, "sample", F.lit("novelty").alias("source"), F.col("score").alias("confidence"))
    from_spans = spans.select(
        *keys,
        F.explode(F.array("start_sample", "end_sample")).alias("sample"),
        F.col("group_id").alias("source"),
        "confidence",
    )
    inside = salted_join(from_spans, tracks.select(*keys, "duration_samples"), keys).where(
        "sample > 0 and sample < duration_samples"
    ).drop("duration_samples")
    merged = from_peaks.unionByName(inside).groupBy(*keys, "sample").agg(
        F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    return ordinal(merged, keys, ["sample"], int_div("sample", block), "_n").select(
        *keys,
        F.format_string("boundary-%03d", F.col("_n") + 1).alias("boundary_id"),
        "sample",
        "confidence",
        "sources",
    )


def apply_selection(
    choices: DataFrame, boundaries: DataFrame, tracks: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Reviewed sections with origin, confidence and a reason for those that must be refused.

    A label, an edge without a boundary or an edge moved off its boundary makes a
    section manual without confidence.
    """
    known = boundaries.select(*keys, "boundary_id", "sample", "confidence")

    def edge(name: str) -> DataFrame:
        return known.select(
            *keys,
            F.col("boundary_id").alias(f"{name}_boundary_id"),
            F.col("sample").alias(f"_{name}_at"),
            F.col("confidence").alias(f"_{name}_conf"),
        )

    rows = (
        salted_join(choices, tracks.select(*keys, "duration_samples"), keys)
        .join(edge("start"), [*keys, "start_boundary_id"], "left")
        .join(edge("end"), [*keys, "end_boundary_id"], "left")
    )
    parts = {}
    for name, at_end in (
        ("start", F.col("start_sample") == 0),
        ("end", F.col("end_sample") == F.col("duration_samples")),
    ):
        ref = F.col(f"{name}_boundary_id")
        at = F.col(f"_{name}_at")
        same = at.isNotNull() & (at == F.col(f"{name}_sample"))
        parts[name] = {
            "bad": F.when(at_end & ref.isNotNull(), "boundary_mismatch").when(
                ~at_end & ref.isNotNull() & at.isNull(), "unknown_boundary"
            ),
            "manual": ~at_end & ~same,
            "conf": F.when(~at_end & same, F.col(f"_{name}_conf")),
        }
    manual = F.col("label").isNotNull() | parts["start"]["manual"] | parts["end"]["manual"]
    return rows.select(
        *keys, "section_id", "start_sample", "end_sample", "label",
        F.when(manual, "manual").otherwise("automatic").alias("origin"),
        F.when(~manual, F.least(parts["start"]["conf"], parts["end"]["conf"])).alias("confidence"),
        F.coalesce(parts["start"]["bad"], parts["end"]["bad"]).alias("reason"),
    )


def selection_policy(
    choices: DataFrame, existing: DataFrame, keys: Sequence[str], policy: str
) -> DataFrame:
    """Tracks whose selection is refused because they already have sections."""
    if policy not in ("require-empty", "replace"):
        raise ValueError(f"unknown policy {policy}")
    refused = choices.select(*keys).distinct().join(
        existing.select(*keys).distinct(), list(keys), "left_semi"
    )
    return refused if policy == "require-empty" else refused.where(F.lit(False))


def incomplete_selections(choices: DataFrame, tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tracks whose selected sections do not reach from 0 to the end of the track, with the reason."""
    edges = choices.groupBy(*keys).agg(
        F.min("start_sample").alias("_first"), F.max("end_sample").alias("_last")
    )
    rows = edges.join(tracks.select(*keys, "duration_samples"), list(keys))
    return rows.where("_first != 0 or _last != duration_samples").select(
        *keys, F.lit("structure_selection_incomplete").alias("reason")
    )


def auto_sections(
    signals: DataFrame,
    tracks: DataFrame,
    keys: Sequence[str],
    hop: int,
    gap: int,
    block: int,
    clocks: DataFrame | None = None,
) -> DataFrame:
    """At most 7 sections at the strongest changes that keep ``gap`` from each other and the ends.

    With ``clocks`` (start_sample and hop_samples of each key) ``hop`` is the smallest hop of all.

    A pick blocks at most 2m-1 hops (m = ceil(gap / hop)), so the picks are among
    the first 5(2m-1)+1 candidates and only those reach one task.
    """
    keys = list(keys)
    lengths = tracks.select(*keys, "duration_samples")
    steps = diff_novelty(signals, keys, hop, block, clocks=clocks)
    picks = MAX_AUTO_BOUNDARIES - 2
    keep = (picks - 1) * (2 * math.ceil(gap / hop) - 1) + 1
    rank = Window.partitionBy(*keys).orderBy(F.desc("_n"), F.desc("sample"))
    few = (
        salted_join(steps, lengths, keys)
        .where("novelty >= threshold and peak > 1e-12")
        .where((F.col("sample") >= gap) & (F.col("duration_samples") - F.col("sample") >= gap))
        .withColumn("_n", F.round("novelty", SCORE_DIGITS))
        .withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") <= keep)
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("_rank", "sample"))), lambda x: x["sample"]
    )
    chosen = F.aggregate(
        ordered,
        F.array().cast("array<bigint>"),
        lambda acc, s: F.when(
            (F.size(acc) >= picks) | F.exists(acc, lambda c: F.abs(c - s) < gap), acc
        ).otherwise(F.concat(acc, F.array(s))),
    )
    # A signal of fewer than three values has no usable change.
    count = signals.groupBy(*keys).agg(F.count("*").alias("_values"))
    picked = few.groupBy(*keys).agg(chosen.alias("_picked")).join(count, keys).where(
        "_values >= 3"
    )
    none = F.array().cast("array<bigint>")
    edges = F.concat(
        F.array(F.lit(0).cast("long")),
        F.array_sort(F.coalesce("_picked", none)),
        F.array("duration_samples"),
    )
    spans = F.transform(
        F.slice("_edges", F.lit(1), F.size("_edges") - 1),
        lambda e, k: F.struct(
            F.format_string("auto-%03d", k + 1).alias("section_id"),
            e.alias("start_sample"),
            F.element_at("_edges", k + 2).alias("end_sample"),
        ),
    )
    return (
        lengths.join(picked.select(*keys, "_picked"), keys, "left")
        .withColumn("_edges", edges)
        .select(*keys, F.inline(spans))
        .withColumn("origin", F.lit("automatic"))
    )


def structure_summary(
    marks: DataFrame,
    boundaries: DataFrame,
    repeats: DataFrame,
    sections: DataFrame,
    keys: Sequence[str],
) -> DataFrame:
    """Counts per track of beats, boundaries, repeat groups, sections and manual sections."""
    def tagged(df: DataFrame, what: str, manual: Column) -> DataFrame:
        return df.select(*keys, F.lit(what).alias("_what"), manual.alias("_manual"))

    no = F.lit(False)
    rows = (
        tagged(marks, "anchor", no)
        .unionByName(tagged(boundaries, "boundary", no))
        .unionByName(tagged(repeats, "repeat", no))
        .unionByName(tagged(sections, "section", F.col("origin") == "manual"))
    )
    counted = lambda what: F.count_if(F.col("_what") == what)
    return rows.groupBy(*keys).agg(
        (counted("anchor") - 2).alias("beats"),
        counted("boundary").alias("boundaries"),
        counted("repeat").alias("repeated_groups"),
        counted("section").alias("sections"),
        F.count_if("_manual").alias("manual_sections"),
    )
