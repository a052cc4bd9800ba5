"""Integer time algebra as Column helpers.

Frame to sample is a floor, event to frame is a ceiling, seconds to samples is
half-even. Products widen to DECIMAL(38,0); a result over 2^53-1 becomes null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.blocks import explode_range, int_div, salted_join

SAMPLE_RATE = 48_000
MAX_SAFE_INTEGER = 2**53 - 1


def _col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def _wide(value) -> Column:
    return _col(value).cast("decimal(19,0)").cast("decimal(38,0)")


def _floor_div(product: Column, divisor: Column) -> Column:
    """Floor of a non-negative wide quotient; null when it is over 2^53-1."""
    limit = (F.lit(MAX_SAFE_INTEGER + 1).cast("decimal(19,0)") * divisor).cast("decimal(38,0)")
    return F.when(product < limit, F.call_function("div", product, divisor))


def _product(*factors) -> Column:
    out = _col(factors[0]).cast("decimal(19,0)")
    for factor in factors[1:]:
        out = (out * _col(factor).cast("decimal(19,0)")).cast("decimal(38,0)")
    return out


def is_safe(value) -> Column:
    value = _col(value)
    return (value >= 0) & (value <= F.lit(MAX_SAFE_INTEGER))


def _narrow_limit(*factors) -> int | None:
    """Largest operand whose product with constant factors fits a long, if all are constants."""
    if not all(isinstance(f, int) and f > 0 for f in factors):
        return None
    return (2**62) // math.prod(factors)


def sample_at_frame(frame, rate, fps_num, fps_den) -> Column:
    """Sample at which a frame starts: floor(frame * rate * den / num)."""
    result = _floor_div(_product(frame, rate, fps_den), _wide(fps_num))
    ok = is_safe(frame) & is_safe(result)
    exact = F.when(ok, result.cast("long"))
    limit = _narrow_limit(rate, fps_den)
    if limit is None or not isinstance(fps_num, int):
        return exact
    # Small operands, which are nearly all, stay in long arithmetic.
    short = int_div(_col(frame).cast("long") * (rate * fps_den), fps_num)
    fits = _col(frame).between(0, limit)
    return F.when(fits, F.when(short <= MAX_SAFE_INTEGER, short)).otherwise(exact)


def first_frame_at_sample(sample, rate, fps_num, fps_den) -> Column:
    """First frame that starts at or after a sample: ceil(sample * num / (rate * den))."""
    divisor = _product(rate, fps_den)
    result = _floor_div(_product(sample, fps_num) + divisor - F.lit(1), divisor)
    ok = is_safe(sample) & is_safe(result)
    exact = F.when(ok, result.cast("long"))
    limit = _narrow_limit(fps_num)
    if limit is None or not isinstance(rate, int) or not isinstance(fps_den, int):
        return exact
    step = rate * fps_den
    if step > 2**62:
        return exact
    short = int_div(_col(sample).cast("long") * fps_num + (step - 1), step)
    fits = _col(sample).between(0, limit)
    return F.when(fits, F.when(short <= MAX_SAFE_INTEGER, short)).otherwise(exact)


def frame_count(duration, rate, fps_num, fps_den) -> Column:
    """Frames needed to cover a duration."""
    return first_frame_at_sample(duration, rate, fps_num, fps_den)


def frame_seconds(frame, fps_num, fps_den) -> Column:
    return _col(frame).cast("double") * _col(fps_den) / _col(fps_num)


def delta_seconds(fps_num, fps_den) -> Column:
    return _col(fps_den).cast("double") / _col(fps_num)


def is_frame_aligned(sample, rate, fps_num, fps_den) -> Column:
    """True when a frame starts exactly at the sample."""
    return sample_at_frame(
        first_frame_at_sample(sample, rate, fps_num, fps_den), rate, fps_num, fps_den
    ) == _col(sample)


def frame_grid(
    ranges: DataFrame, rate, fps_num, fps_den, start="start_sample", end="end_sample"
) -> DataFrame:
    """One row per frame of each half-open range, with global frame numbers.

    A long range is cut into runs before it is exploded, so no task makes all of it.
    """
    first = first_frame_at_sample(start, rate, fps_num, fps_den)
    stop = first_frame_at_sample(end, rate, fps_num, fps_den)
    return explode_range(ranges, first, stop, "frame").withColumn(
        "sample", sample_at_frame("frame", rate, fps_num, fps_den)
    )


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by at most 90 remainder steps (enough for 18 digits)."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(90)),
        F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(
            F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))
        ),
    )
    return step["a"]


def parse_rate(text) -> Column:
    """``"30000/1001"`` or ``"30"`` to a reduced struct(num, den); null when malformed."""
    text = _col(text)
    num = F.regexp_extract(text, r"^([0-9]{1,18})(?:/([0-9]{1,18}))?$", 1)
    den = F.regexp_extract(text, r"^([0-9]{1,18})(?:/([0-9]{1,18}))?$", 2)
    n = F.when(num != "", num.cast("long"))
    d = F.when(den != "", den.cast("long")).otherwise(F.when(num != "", F.lit(1).cast("long")))
    g = _gcd(n, d)
    good = (n > 0) & (d > 0)
    return F.when(
        good, F.struct(int_div(n, g).alias("num"), int_div(d, g).alias("den"))
    )


def lrc_samples(minutes: Column, seconds: Column, fraction: Column) -> Column:
    """LRC clock text to samples; the fraction is truncated to a sample, not rounded."""
    sec = seconds.try_cast("long")
    digits = F.rpad(F.coalesce(fraction, F.lit("")), 9, "0").try_cast("long")
    part = int_div(digits * SAMPLE_RATE, 1_000_000_000)
    whole = (minutes.try_cast("decimal(12,0)").cast("long") * 60 + sec) * SAMPLE_RATE
    return F.when(sec < 60, whole + part)


#: Stands for a number of more digits than 38-digit arithmetic holds: later than any track.
BEYOND = "1" + "0" * 36


def wide_integer(digits: Column) -> Column:
    """Digits with an optional sign as a 38-digit integer; over 28 digits count as ``BEYOND``."""
    value = F.coalesce(digits.try_cast("decimal(28,0)").cast("decimal(38,0)"), F.lit(BEYOND).cast("decimal(38,0)"))
    return F.when(F.length(digits) > 0, value)


def srt_samples_wide(hours: Column, minutes: Column, seconds: Column, millis: Column) -> Column:
    """SRT clock text to samples of 38 digits, whatever the hours; 48 samples per millisecond."""
    h = F.least(wide_integer(hours), F.lit("1" + "0" * 28).cast("decimal(38,0)"))
    m, s = minutes.cast("long"), seconds.cast("long")
    rest = ((m * 60 + s) * 1000 + millis.cast("long")) * 48
    whole = (h * F.lit(172_800_000)).cast("decimal(38,0)")
    return F.when((m < 60) & (s < 60), (whole + rest).cast("decimal(38,0)"))


def srt_samples(hours: Column, minutes: Column, seconds: Column, millis: Column) -> Column:
    """SRT clock text to samples; null when the clock is malformed or leaves the 64-bit range."""
    return srt_samples_wide(hours, minutes, seconds, millis).try_cast("long")


def seconds_to_range(start, end, duration, rate: int = SAMPLE_RATE) -> Column:
    """Seconds to a clamped, non-empty sample range; half-even like the word timings need."""
    start, end, duration = _col(start), _col(end), _col(duration)
    lo = F.greatest(
        F.lit(0).cast("long"), F.least(duration - 1, F.bround(start * rate, 0).cast("long"))
    )
    hi = F.greatest(lo + 1, F.least(duration, F.bround(end * rate, 0).cast("long")))
    ok = (end > start) & (end > 0) & (start * rate < duration)
    return F.when(ok, F.struct(lo.alias("start_sample"), hi.alias("end_sample")))


def pulse_frames(
    events: DataFrame, name: str, rate, fps_num, fps_den, tracks: DataFrame | None = None
) -> DataFrame:
    """Distinct frames of one event name; tracks without such an event get a reason row."""
    frames = (
        events.where(F.col("name") == name)
        .select(
            "track_id", first_frame_at_sample("sample", rate, fps_num, fps_den).alias("frame")
        )
        .distinct()
    )
    if tracks is None:
        return frames.withColumn("reason", F.lit(None).cast("string"))
    missing = tracks.select("track_id").join(
        frames.select("track_id").distinct(), "track_id", "left_anti"
    )
    return frames.withColumn("reason", F.lit(None).cast("string")).unionByName(
        missing.select(
            "track_id",
            F.lit(None).cast("long").alias("frame"),
            F.lit("missing_pulse_event").alias("reason"),
        )
    )


def with_clock(df: DataFrame, tracks: DataFrame) -> DataFrame:
    """Attach clock columns of the track to each row, safe for a hot track."""
    return salted_join(df, tracks, ["track_id"])
