"""Features of hop-sampled signals, in long form ``(keys, idx, value)``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import clock
from trackloom.functions.blocks import (
    blocked_fold,
    explode_range,
    halo_window,
    home_rows,
    int_div,
    salted_join,
    spread,
    with_halo,
)

SILENCE = 1e-12
LOW_FREQUENCY_MAX_HZ = 200.0
# Pitch classes in order from C, as used in signal names.
PITCH_CLASSES = ("c", "c_sharp", "d", "d_sharp", "e", "f", "f_sharp", "g", "g_sharp", "a",
                 "a_sharp", "b")


def frame_hops(
    samples: DataFrame, lengths: DataFrame, keys: Sequence[str], hop: int
) -> DataFrame:
    """Per-hop sums for ceil(length / hop) hops; hops without samples count as zeros.

    ``lengths`` holds one ``duration_samples`` per key.
    """
    sums = samples.groupBy(*keys, int_div("sample", hop).alias("idx")).agg(
        F.sum("value").alias("total"),
        F.sum(F.col("value") * F.col("value")).alias("energy"),
        F.count("*").alias("samples"),
    )
    hops = int_div(F.col("duration_samples") + (hop - 1), hop)
    grid = explode_range(
        lengths.select(*keys, "duration_samples"), F.lit(0), hops, "idx"
    ).drop("duration_samples")
    return grid.join(sums, [*keys, "idx"], "left").fillna(
        {"total": 0.0, "energy": 0.0, "samples": 0}
    )


def hop_rms(
    samples: DataFrame,
    keys: Sequence[str],
    hop: int,
    frame: int,
    position: str = "sample",
    lengths: DataFrame | None = None,
) -> DataFrame:
    """RMS of each frame of ``frame`` samples, zero-padded tail.

    A sample adds its square to each frame that holds it, so one aggregation with
    map-side combine does the framing; no window and no second shuffle. With ``lengths``
    (one ``duration_samples`` per key) there is one frame per hop, those without samples
    being 0; without, only frames that hold samples have a row.
    """
    if frame % hop:
        raise ValueError("frame must be a multiple of hop")
    last = int_div(position, hop)
    first = F.greatest(F.lit(0).cast("long"), last - (frame // hop - 1))
    squares = samples.select(
        *keys,
        F.explode(F.sequence(first, last)).alias("idx"),
        (F.col("value") * F.col("value")).cast("double").alias("_square"),
    )
    if lengths is not None:
        hops = int_div(F.col("duration_samples") + (hop - 1), hop)
        every = explode_range(lengths.select(*keys, "duration_samples"), F.lit(0), hops, "idx")
        squares = squares.unionByName(every.select(*keys, "idx", F.lit(0.0).alias("_square")))
    return squares.groupBy(*keys, "idx").agg(F.sqrt(F.sum("_square") / frame).alias("value"))


def finite(value: Column) -> Column:
    """NaN and infinities become 0."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad | value.isNull(), 0.0).otherwise(value)


def normalize(signals: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Divide by the observed maximum of |value|; silence gives zeros; clip to [0, 1]."""
    clean = signals.withColumn(value, finite(F.col(value)))
    peak = clean.groupBy(*keys).agg(F.max(F.abs(value)).alias("_peak"))
    scaled = F.when(F.col("_peak") <= SILENCE, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value) / F.col("_peak")))
    )
    return salted_join(clean, peak, keys).withColumn(value, scaled).drop("_peak")


def sample_frames(
    samples: DataFrame, keys: Sequence[str], hop: int, frame: int
) -> DataFrame:
    """Array of the ``frame`` samples from each hop on, zero-padded; a group is one frame."""
    last = int_div("sample", hop)
    first = F.greatest(F.lit(0).cast("long"), last - (frame // hop - 1))
    rows = samples.withColumn("idx", F.explode(F.sequence(first, last)))
    pairs = rows.groupBy(*keys, "idx").agg(
        F.map_from_entries(
            F.collect_list(F.struct((F.col("sample") - F.col("idx") * hop).cast("int"), "value"))
        ).alias("_at")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(frame - 1)), lambda i: F.coalesce(F.col("_at")[i], F.lit(0.0))
    )
    return pairs.select(*keys, "idx", dense.alias("frame"))


def _spectrum(frames: pd.Series) -> np.ndarray:
    data = np.stack(frames.to_numpy()).astype(np.float64)
    n = data.shape[1]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    return np.fft.rfft(data * taper, axis=1)


def band_energy(
    frames: DataFrame, keys: Sequence[str], rate: float, f_max: float = LOW_FREQUENCY_MAX_HZ
) -> DataFrame:
    """RMS of the tapered DFT magnitudes of all bins up to ``f_max``."""

    @F.pandas_udf("double")
    def low(frame: pd.Series) -> pd.Series:
        power = np.abs(_spectrum(frame)) ** 2
        bins = np.arange(power.shape[1]) * rate / len(frame.iloc[0]) <= f_max
        return pd.Series(np.sqrt(power[:, bins].mean(axis=1)))

    return frames.select(*keys, "idx", low("frame").alias("value"))


def pitch_class_energy(frames: DataFrame, keys: Sequence[str], rate: float) -> DataFrame:
    """Power per pitch class of each frame; a bin goes to its nearest semitone (A4 = 440 Hz)."""

    @F.pandas_udf("array<double>")
    def classes(frame: pd.Series) -> pd.Series:
        power = np.abs(_spectrum(frame)) ** 2
        hertz = np.arange(1, power.shape[1]) * rate / len(frame.iloc[0])
        semitone = np.rint(69 + 12 * np.log2(hertz / 440.0)).astype(int) % 12
        weight = (semitone[:, None] == np.arange(12)[None, :]).astype(np.float64)
        return pd.Series(list(power[:, 1:] @ weight))

    names = F.array(*[F.lit(n) for n in PITCH_CLASSES])
    return (
        frames.select(*keys, "idx", classes("frame").alias("_c"))
        .select(*keys, "idx", F.posexplode("_c").alias("_k", "value"))
        .select(*keys, "idx", names[F.col("_k")].alias("pitch_class"), "value")
    )


def onset_envelope(bands: DataFrame, keys: Sequence[str], band: str, block: int) -> DataFrame:
    """Sum over bands of the positive change from the previous hop."""
    rows = with_halo(bands, "idx", block, before=1)
    change = F.col("value") - F.lag("value").over(halo_window([*keys, band], "idx"))
    return (
        home_rows(rows.withColumn("_rise", F.greatest(change, F.lit(0.0))))
        .groupBy(*keys, "idx")
        .agg(F.coalesce(F.sum("_rise"), F.lit(0.0)).alias("value"))
    )


def envelope_peaks(
    envelope: DataFrame,
    keys: Sequence[str],
    block: int,
    pre_max: int = 2,
    post_max: int = 1,
    pre_avg: int = 9,
    post_avg: int = 10,
    delta: float = 0.07,
) -> DataFrame:
    """Hops that are the maximum of their surroundings and ``delta`` above the local mean.

    The surroundings of hop n are ``[n - pre, n + post)``.
    """
    rows = with_halo(
        envelope, "idx", block, max(pre_max, pre_avg), max(post_max, post_avg)
    )
    w = halo_window(keys, "idx")
    top = F.max("value").over(w.rangeBetween(-pre_max, post_max - 1))
    mean = F.avg("value").over(w.rangeBetween(-pre_avg, post_avg - 1))
    peak = (F.col("value") == top) & (F.col("value") >= mean + delta) & (F.col("value") > 0)
    return home_rows(rows.withColumn("_peak", peak)).where("_peak").drop("_peak")


def minimum_wait(peaks: DataFrame, keys: Sequence[str], wait: int, block: int) -> DataFrame:
    """Greedy from the left: keep a peak only if it is more than ``wait`` hops after the last kept.

    The state at a block border is how many hops are still blocked (0 to wait),
    so a block's effect is a table of wait + 1 numbers.
    """
    if block <= wait:
        raise ValueError("block must be longer than wait")
    def walk(index, allowed):
        kept = []
        for i in index:
            if i >= allowed:
                kept.append(i)
                allowed = i + wait + 1
        return kept, allowed

    def effects(batch):
        out = []
        for number, index in zip(batch["_block"], batch["_index"], strict=True):
            start = number * block
            ends = [walk(index, start + blocked)[1] for blocked in range(wait + 1)]
            out.append(([max(0, int(end) - start - block) for end in ends],))
        return out

    def entered(state, before, first):
        return int(state) if before is not None and first == before + 1 else 0

    def compose(left, right):
        # Blocks are longer than the wait, so nothing is carried over a block without peaks.
        return ([int(right[2][entered(state, left[1], right[0])]) for state in left[2]],)

    def step(state, before, link):
        entry = entered(state, before, link[0])
        return entry, int(link[2][entry])

    def run(batch):
        kept = [
            walk(index, number * block + entry)[0]
            for number, index, entry in zip(batch["_block"], batch["_index"], batch["_entry"], strict=True)
        ]
        return [len(k) for k in kept], (np.concatenate([np.array(k, dtype=np.int64) for k in kept]),)

    cut = spread(
        peaks.select(*keys, "idx").withColumn("_block", int_div("idx", block)), *keys, "_block"
    )
    packed = cut.groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list("idx")).alias("_index")
    )
    kept = blocked_fold(
        packed, keys, effects, "_after array<int>", compose, step, "int", run, "idx bigint"
    )
    return peaks.join(kept, [*keys, "idx"], "left_semi")


def detect_onsets(
    envelope: DataFrame, keys: Sequence[str], block: int, wait: int = 2, **surroundings
) -> DataFrame:
    """Onset hops of a normalized envelope."""
    peaks = envelope_peaks(envelope, keys, block, **surroundings)
    return minimum_wait(peaks, keys, wait, block)


def beat_period(
    envelope: DataFrame, keys: Sequence[str], lags: range, block: int
) -> DataFrame:
    """Lag with the largest autocorrelation; the shorter lag wins a tie.

    All lags are read by ``lead`` in one window pass over blocks with a halo, so
    there is no self-join; per-block sums combine before the shuffle by track.
    """
    rows = with_halo(envelope, "idx", block, after=max(lags))
    w = halo_window(keys, "idx")
    products = [
        (F.col("value") * F.lead("value", lag).over(w)).alias(f"_l{lag}") for lag in lags
    ]
    sums = (
        home_rows(rows.select(*keys, "_block", "_home", *products))
        .groupBy(*keys)
        .agg(*[F.coalesce(F.sum(f"_l{lag}"), F.lit(0.0)).alias(f"_l{lag}") for lag in lags])
    )
    scored = F.array(
        *[
            F.struct(F.round(F.col(f"_l{lag}"), 6).alias("s"), F.lit(-lag).alias("neg"))
            for lag in lags
        ]
    )
    return sums.select(*keys, F.array_max(scored).alias("_best")).select(
        *keys, (-F.col("_best.neg")).cast("long").alias("lag"), F.col("_best.s").alias("strength")
    )


def estimate_beats(
    envelope: DataFrame, keys: Sequence[str], lags: range, block: int
) -> DataFrame:
    """Beat grid: best lag, then the phase with the most envelope, earliest on a tie."""
    period = beat_period(envelope, keys, lags, block)
    phases = (
        salted_join(envelope, period, keys)
        .groupBy(*keys, "lag", (F.col("idx") % F.col("lag")).alias("_phase"))
        .agg(F.sum("value").alias("_sum"))
        .groupBy(*keys, "lag")
        .agg(
            F.max_by(
                "_phase", F.struct(F.round("_sum", 6).alias("s"), (-F.col("_phase")).alias("p"))
            ).alias("phase"),
        )
    )
    return (
        salted_join(envelope.select(*keys, "idx"), phases, keys)
        .where("idx % lag = phase")
        .select(*keys, "lag", "phase", "idx")
    )


def events_from_frames(
    frames: DataFrame,
    envelope: DataFrame,
    tracks: DataFrame,
    name: str,
    source: str,
    hop: int,
    keys: Sequence[str] = ("track_id",),
) -> DataFrame:
    """Picked hops as events; confidence is the normalized envelope at that hop."""
    keys = list(keys)
    level = normalize(envelope, keys).select(*keys, "idx", F.col("value").alias("confidence"))
    rows = frames.select(*keys, "idx").join(level, [*keys, "idx"], "left")
    return (
        salted_join(rows, tracks.select(*keys, "duration_samples"), keys)
        .withColumn("sample", F.col("idx") * hop)
        .where("sample < duration_samples")
        .select(*keys, F.lit(name).alias("name"), F.lit(source).alias("source"), "sample",
                "confidence")
    )


def sample_signal(
    signals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    hop: int,
    block: int,
    start: int = 0,
    at: str = "sample",
    name: str = "level",
    clocks: DataFrame | None = None,
) -> DataFrame:
    """Linear value of a signal at each point, held at both ends.

    On a regular hop the as-of partner is computed, so this is an equi-join on
    ``(keys, idx)``. ``signals`` holds dense ``idx`` from 0. ``clocks`` gives each key a
    ``start_sample`` and ``hop_samples`` of its own in place of ``start`` and ``hop``.
    """
    rows = with_halo(signals.select(*keys, "idx", "value"), "idx", block, after=1)
    w = halo_window(keys, "idx")
    pairs = home_rows(rows.withColumn("_next", F.lead("value").over(w))).withColumnsRenamed(
        {"idx": "_left", "value": "_value"}
    )
    last = _with_clock(signals.groupBy(*keys).agg(F.max("idx").alias("_last")), keys, start, hop, clocks)
    place = F.greatest(F.lit(0.0), (F.col(at) - F.col("_start")) / F.col("_hop").cast("double"))
    looked = (
        salted_join(points, last, keys)
        .withColumn("_place", place)
        .withColumn("_left", F.least(F.floor("_place").cast("long"), F.col("_last")))
        .join(pairs, [*keys, "_left"], "left")
    )
    value = F.col("_value") + F.when(
        F.col("_next").isNull(), 0.0
    ).otherwise((F.col("_next") - F.col("_value")) * (F.col("_place") - F.col("_left")))
    return looked.withColumn(name, value).drop(
        "_place", "_last", "_left", "_value", "_next", "_start", "_hop"
    )


def sample_grid(
    signals: DataFrame,
    tracks: DataFrame,
    keys: Sequence[str],
    hop: int,
    hop_block: int,
    block: int,
    rate: int,
    fps_num: int,
    fps_den: int,
    start: int = 0,
    name: str = "levels",
) -> DataFrame:
    """``sample_signal`` on every frame of a track, in blocks of ``block`` frames.

    One row per (keys, _block): ``first_frame`` and the array ``name`` over its dense frames.
    Every hop makes its own frames after it is moved, so no frame is moved or joined.
    ``tracks``: keys, duration_samples.
    """
    keys = list(keys)

    def first_frame(sample: Column) -> Column:
        return clock.first_frame_at_sample(sample, rate, fps_num, fps_den)

    rows = with_halo(signals.select(*keys, "idx", "value"), "idx", hop_block, after=1)
    pairs = home_rows(rows.withColumn("_next", F.lead("value").over(halo_window(keys, "idx"))))
    ends = signals.groupBy(*keys).agg(F.max("idx").alias("_last")).join(
        tracks.select(*keys, first_frame(F.col("duration_samples")).alias("_stop")), keys
    )
    idx = F.col("idx")
    edge = lambda n: first_frame(n * hop + start)
    own = (
        salted_join(pairs, ends, keys)
        .withColumn("_lo", F.when(idx == 0, 0).otherwise(edge(idx)).cast("long"))
        .withColumn("_hi", F.when(idx < F.col("_last"), F.least("_stop", edge(idx + 1))).otherwise(F.col("_stop")))
        .where("_lo < _hi")
        .withColumn("_block", F.explode(F.sequence(int_div("_lo", block), int_div(F.col("_hi") - 1, block))))
    )
    piece = F.struct(
        F.greatest("_lo", F.col("_block") * block).alias("lo"),
        F.least("_hi", (F.col("_block") + 1) * block).alias("hi"),
        "idx", "value", F.col("_next").alias("next"),
    )
    hops = own.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(piece)).alias("_hops"))

    def levels(h: Column) -> Column:
        def level(frame: Column) -> Column:
            sample = clock.sample_at_frame(frame, rate, fps_num, fps_den)
            place = F.greatest(F.lit(0.0), (sample - start) / F.lit(float(hop)))
            rise = (h["next"] - h["value"]) * (place - h["idx"])
            return h["value"] + F.when(h["next"].isNull(), 0.0).otherwise(rise)

        return F.transform(F.sequence(h["lo"], h["hi"] - 1), level)

    return hops.select(
        *keys, "_block", F.get("_hops", F.lit(0))["lo"].alias("first_frame"),
        F.flatten(F.transform("_hops", levels)).alias(name),
    )


def _with_clock(
    per_key: DataFrame, keys: Sequence[str], start: int, hop: int, clocks: DataFrame | None
) -> DataFrame:
    """Add ``_start`` and ``_hop`` to one row per key: those of ``clocks``, or the same for all."""
    if clocks is None:
        return per_key.withColumns({"_start": F.lit(start).cast("long"), "_hop": F.lit(hop).cast("long")})
    own = clocks.select(*keys, F.col("start_sample").alias("_start"), F.col("hop_samples").alias("_hop"))
    return per_key.join(own, list(keys))


def diff_novelty(
    signals: DataFrame,
    keys: Sequence[str],
    hop: int,
    block: int,
    start: int = 0,
    clocks: DataFrame | None = None,
) -> DataFrame:
    """|first difference| of a signal, with mean + one population deviation as threshold.

    ``clocks`` gives each key a ``start_sample`` and ``hop_samples`` of its own.
    """
    rows = with_halo(signals, "idx", block, before=1)
    step = F.abs(F.col("value") - F.lag("value").over(halo_window(keys, "idx")))
    steps = home_rows(rows.withColumn("novelty", step)).where("novelty is not null").select(
        *keys, "idx", "novelty"
    )
    stats = steps.groupBy(*keys).agg(
        (F.avg("novelty") + F.stddev_pop("novelty")).alias("threshold"),
        F.max("novelty").alias("peak"),
    )
    return salted_join(steps, _with_clock(stats, keys, start, hop, clocks), keys).select(
        *keys, "idx", (F.col("_start") + F.col("idx") * F.col("_hop")).alias("sample"), "novelty", "threshold", "peak"
    )


def length_plan(lengths: DataFrame) -> DataFrame:
    """none / pad / trim from ``natural_samples`` and ``target_samples``."""
    delta = F.col("target_samples") - F.col("natural_samples")
    return lengths.withColumn("delta_samples", delta).withColumn(
        "action", F.when(delta == 0, "none").when(delta > 0, "pad").otherwise("trim")
    )


def align_length(samples: DataFrame, plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Apply a length plan: drop samples past the target, add zero samples up to it."""
    target = plan.select(*keys, "target_samples")
    kept = salted_join(samples, target, keys).where("sample < target_samples")
    zeros = explode_range(
        plan.where("action = 'pad'"), F.col("natural_samples"), F.col("target_samples"), "sample"
    ).select(*keys, "sample", F.lit(0.0).alias("value"))
    return kept.select(*keys, "sample", "value").unionByName(zeros)


def recon_snr(parts: DataFrame, whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signal-to-noise ratio in dB of the summed parts against the whole."""
    total = parts.groupBy(*keys, "sample").agg(F.sum("value").alias("_sum"))
    both = whole.select(*keys, "sample", "value").join(total, [*keys, "sample"], "left")
    noise = F.col("value") - F.coalesce("_sum", F.lit(0.0))
    sums = both.groupBy(*keys).agg(
        F.sum(F.col("value") * F.col("value")).alias("_signal"),
        F.sum(noise * noise).alias("_noise"),
        F.count("*").alias("samples"),
    )
    ratio = F.when(
        F.col("_noise") > 0, 10 * F.log10(F.col("_signal") / F.col("_noise"))
    )
    return sums.select(*keys, "samples", ratio.alias("snr_db"))


def required_signals(mode: Column) -> Column:
    """Names of the signals that an analysis mode must deliver."""
    base = ["mix.rms", *[f"mix.chroma.{c}" for c in PITCH_CLASSES]]
    stems = [f"{s}.rms" for s in ("drums", "bass", "vocals", "other")] + ["bass.low_energy"]
    as_array = lambda names: F.array(*[F.lit(n) for n in names])
    return F.when(mode == "none", as_array(base)).when(mode == "four", as_array(base + stems))
