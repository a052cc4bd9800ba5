"""Text helpers: lines, stage headings, text keys, caption tokens, cue curves."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text patterns of the lyric formats.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
# White space of any script, as a character class for Java and RE2 patterns alike.
WHITE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
#: The characters of ``WHITE`` themselves.
WHITE_CHARS = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000)
)
STAGE_HEADING = rf"^[{WHITE}]*(?:#{{1,6}}[{WHITE}]+.+|\[[^\]\r\n]+\])[{WHITE}]*$"
BRACKET_HEADING = rf"^[{WHITE}]*\[[^\]\r\n]+\][{WHITE}]*$"
CAPTION_TOKEN = rf"[{WHITE}]+|[A-Za-z0-9]+(?:['’_-][A-Za-z0-9]+)*(?:[.,;:!?]+)?|."
MAX_LINE = 240


def strip(text: Column) -> Column:
    """Trim white space, then byte order marks, at both ends."""
    return F.btrim(trim(text), F.lit("\ufeff"))


def trim(text: Column) -> Column:
    """Trim white space of any script at both ends; only the ends are read, no pattern runs over the text."""
    return F.btrim(text, F.lit(WHITE_CHARS))


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def is_heading(text: Column) -> Column:
    return text.rlike(STAGE_HEADING)


def is_bracket_heading(text: Column) -> Column:
    """Timed formats know only the bracket form."""
    return text.rlike(BRACKET_HEADING)


# Everything that is not a letter or digit in any script (a word character but "_").
_NOT_ALNUM = re.compile(r"[\W_]+")


def _key(value: str) -> str:
    return _NOT_ALNUM.sub("", unicodedata.normalize("NFKC", value)).casefold()


@F.pandas_udf(T.StringType())
def norm_key(text: pd.Series) -> pd.Series:
    """NFKC, case-folded, letters and digits only."""
    return text.map(lambda value: None if value is None else _key(value))


@F.pandas_udf(T.ArrayType(T.StringType()))
def norm_keys(texts: pd.Series) -> pd.Series:
    """``norm_key`` of each element."""
    return texts.map(lambda values: None if values is None else [_key(x) for x in values])


def caption_tokens(text: Column) -> Column:
    """Words stay whole with their trailing punctuation; other characters stand alone."""
    return F.regexp_extract_all(text, F.lit(CAPTION_TOKEN), F.lit(0))


def cue_opacity(start: Column, end: Column, at: Column, fade: Column) -> Column:
    """0 outside the cue; inside a ramp from 0.15 to 1 over at most half its length."""
    ramp_len = F.least(fade, F.floor((end - start) / 2).cast("long"))
    ramp = F.least(F.lit(1.0), (at - start) / ramp_len, (end - at) / ramp_len)
    return (
        F.when((at < start) | (at >= end), 0.0)
        .when(ramp_len == 0, 1.0)
        .otherwise(0.15 + 0.85 * ramp)
    )


def smoothstep(low: float, high: float, value: Column) -> Column:
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return ratio * ratio * (3 - 2 * ratio)


def cue_motion(start: Column, end: Column, at: Column) -> Column:
    """struct(progress, bulge_x, bulge, trail, lift, scale) of an animated cue."""
    inside = (at >= start) & (at < end)
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - start) / (end - start)))
    entrance = 1 - smoothstep(0, 0.16, progress)
    leaving = smoothstep(0.84, 1, progress)

    def pick(value: Column, rest: float, name: str) -> Column:
        return F.when(inside, value).otherwise(F.lit(rest)).alias(name)

    return F.struct(
        pick(progress, 0.0, "progress"),
        pick(0.24 + 0.52 * smoothstep(0, 1, progress), 0.24, "bulge_x"),
        pick(0.15 + 0.075 * F.sin(math.pi * progress), 0.0, "bulge"),
        pick(F.greatest(entrance, leaving), 0.0, "trail"),
        pick(-0.035 * entrance + 0.022 * leaving, 0.0, "lift"),
        pick(
            0.965 + 0.035 * smoothstep(0, 0.18, progress) - 0.012 * leaving, 1.0, "scale"
        ),
    )
