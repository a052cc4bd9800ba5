"""Timed text: line extraction, LRC and SRT import, known-text alignment and its evaluation.

One document is one row, so its lines are worked on as arrays inside that row:
no shuffle, and a long document costs only its own row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import clock
from trackloom.functions import text as tx
from trackloom.functions.blocks import (
    int_div,
    neighbour,
    ordinal,
    owner_interval,
    running_sum,
    salted_join,
    tasks_for,
)
from trackloom.operators.tiles import TILE, align_blocks, known_blocks, observed_blocks
from trackloom.sources.tables import materialize

# Limits of the alignment and patterns of the import formats.
MIN_COVERAGE = 0.45
MIN_MATCHED = 2
MIN_CUE_SAMPLES = 14_400
MAX_KNOWN = 20_000
MAX_OBSERVED = 50_000
GATE_MEDIAN = 12_000
GATE_P90 = 24_000
MIN_REFERENCES = 12
LRC_OFFSET = rf"(?i)^[{tx.WHITE}]*\[offset:([+-]?\d+)\][{tx.WHITE}]*$"
LRC_STAMP = r"\[(\d{1,3}):(\d{2})(?:[.:](\d{1,3}))?\]"
LRC_METADATA = rf"^[{tx.WHITE}]*\[[A-Za-z][A-Za-z0-9_-]*:.*\][{tx.WHITE}]*$"
SRT_TIMING = (
    rf"^(\d{{2,}}):(\d{{2}}):(\d{{2}})[,.](\d{{3}})[{tx.WHITE}]+-->[{tx.WHITE}]+"
    r"(\d{2,}):(\d{2}):(\d{2})[,.](\d{3})$"
)


def known_lines(corpus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Usable lines with line number and text key; a reason marks what must be refused.

    Blank lines and stage headings are dropped, numbers count all lines. A document
    with a line over 240 characters, over 20000 key characters or without lines is
    refused: the reason stands in every row of it.
    """
    keys = list(keys)
    texts = F.transform(tx.lines(F.col("text")), lambda x: tx.strip(x))
    rows = corpus.select(*keys, texts.alias("_texts")).withColumn(
        "_keys", tx.norm_keys("_texts")
    )
    zipped = F.zip_with(
        "_texts", "_keys", lambda x, k: F.struct(x.alias("text"), k.alias("key"))
    )
    numbered = F.transform(
        zipped,
        lambda x, i: F.struct((i + 1).cast("long").alias("line"), x["text"].alias("text"),
                              x["key"].alias("key")),
    )
    shown = F.filter(numbered, lambda x: (x["text"] != "") & ~tx.is_heading(x["text"]))
    kept = F.filter("_shown", lambda x: x["key"] != "")
    total = F.aggregate("_lines", F.lit(0), lambda a, x: a + F.length(x["key"]))
    docs = (
        rows.select(*keys, shown.alias("_shown"))
        .select(
            *keys, kept.alias("_lines"),
            F.exists("_shown", lambda x: F.length(x["text"]) > tx.MAX_LINE).alias("_long"),
        )
        .withColumn("_total", total)
    )
    reason = (
        F.when(F.col("_long"), "lyric_text_too_long")
        .when(F.col("line").isNull(), "no_lyric_lines")
        .when(F.col("_total") > MAX_KNOWN, "alignment_text_too_large")
    )
    # One pass: a document without usable lines comes out as one row without a line.
    return docs.select(*keys, "_total", "_long", F.explode_outer("_lines").alias("line")).select(
        *keys, "line.line", "line.text", "line.key", reason.alias("reason")
    )


def _exploded(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the cues of documents without a reason, one row with the reason for each other document.

    One explode of an array chosen in the row: no join and no filter between them.
    """
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    cues = F.transform(
        "_cues",
        lambda c, k: F.struct(
            k.cast("long").alias("cue_idx"), c["start"].cast("long").alias("start_sample"),
            c["end"].cast("long").alias("end_sample"), c["text"].alias("text"), nothing("string", "reason"),
        ),
    )
    refusal = F.array(
        F.struct(
            nothing("long", "cue_idx"), nothing("long", "start_sample"), nothing("long", "end_sample"),
            nothing("string", "text"), F.col("_reason").alias("reason"),
        )
    )
    chosen = F.when(F.col("_reason").isNull(), cues).otherwise(refusal)
    return parsed.select(*keys, F.explode(chosen).alias("_c")).select(*keys, "_c.*")


def _parsed_lrc(corpus: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _cues, _reason, _offset, _skipped: a document is parsed in its row, without a shuffle.

    Offsets and clocks of any number of digits are compared in 38-digit arithmetic.
    """
    raw = F.transform(
        tx.lines(F.coalesce("text", F.lit(""))), lambda x: F.regexp_replace(x, "^﻿+|﻿+$", "")
    )

    def line(x, i):
        is_offset = x.rlike(LRC_OFFSET)
        group = lambda n: F.regexp_extract_all(x, F.lit(LRC_STAMP), F.lit(n))
        return F.struct(
            i.alias("i"),
            F.when(is_offset, clock.wide_integer(F.regexp_extract(x, LRC_OFFSET, 1))).alias("millis"),
            F.when(is_offset, F.array()).otherwise(
                F.arrays_zip(group(1).alias("m"), group(2).alias("s"), group(3).alias("f"))
            ).alias("stamps"),
            tx.trim(F.regexp_replace(x, LRC_STAMP, "")).alias("text"),
            (~is_offset & ~x.rlike(LRC_STAMP) & (tx.trim(x) != "") & ~x.rlike(LRC_METADATA)).alias("unsupported"),
        )

    wide = lambda c: c.cast("decimal(38,0)")
    timed = lambda p: (F.size(p["stamps"]) > 0) & (p["text"] != "")
    last = lambda rows: F.get(rows, F.size(rows) - 1)["millis"]

    def starts(p):
        before = last(F.filter("_offsets", lambda o: o["i"] < p["i"]))
        shift = F.coalesce(wide(before * 48), wide(F.lit(0)))
        return F.transform(
            p["stamps"],
            lambda t: F.struct(
                wide(wide(clock.lrc_samples(t["m"], t["s"], t["f"])) + shift).alias("start"), p["text"].alias("text")
            ),
        )

    lyric = lambda p: timed(p) & ~tx.is_bracket_heading(p["text"])
    rows = (
        corpus.select(*keys, wide(F.col("duration_samples")).alias("_duration"), F.transform(raw, line).alias("_lines"))
        # Each array below is read more than once, so that it is computed once a document.
        .withColumn("_offsets", F.filter("_lines", lambda p: p["millis"].isNotNull()))
        .select(
            *keys, "_duration",
            F.coalesce(last(F.col("_offsets")) * 48, F.lit(0)).alias("_offset"),
            F.size(F.filter("_lines", lambda p: timed(p) & tx.is_bracket_heading(p["text"]))).alias("_skipped"),
            F.exists("_lines", lambda p: p["unsupported"]).alias("_unsupported"),
            F.flatten(F.transform(F.filter("_lines", lyric), starts)).alias("_starts"),
        )
    )
    ended = F.transform(
        "_starts",
        lambda c, k: F.struct(
            c["start"].alias("start"), F.coalesce(F.get("_starts", k + 1)["start"], "_duration").alias("end"),
            c["text"].alias("text"),
        ),
    )
    any_cue = lambda test: F.exists("_cues", test)
    reason = (
        F.when(F.col("_unsupported"), "unsupported_lyric_line")
        .when(F.size("_cues") == 0, "no_lyric_cues")
        .when(any_cue(lambda c: F.length(c["text"]) > tx.MAX_LINE), "lyric_text_too_long")
        .when(any_cue(lambda c: c["start"].isNull()), "invalid_lyric_timestamp")
        .when(any_cue(lambda c: (c["start"] < 0) | (c["start"] >= F.col("_duration"))), "lyrics_out_of_bounds")
        .when(any_cue(lambda c: c["end"] <= c["start"]), "non_monotonic_lyrics")
    )
    return rows.withColumn("_cues", ended).withColumn("_reason", reason)


def lrc_cues(corpus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """LRC documents (``text``, ``duration_samples``) to cues that end at the next start.

    An offset line moves only the lines after it. A refused document has one row with
    its reason; one with several mistakes reports the first of the list in the code.
    """
    keys = list(keys)
    return _exploded(_parsed_lrc(corpus, keys), keys)


def _parsed_srt(corpus: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _cues, _reason, _skipped: a document is parsed in its row, without a shuffle."""
    text = F.btrim(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\ufeff\n "))
    bodies = F.transform(
        F.split(text, rf"\n[{tx.WHITE}]*\n"),
        lambda x: F.split(F.regexp_replace(x, rf"^[{tx.WHITE}]*\d+[{tx.WHITE}]*?(?:\n|$)", ""), "\n", 2),
    )

    # One step after the other, each over the structs of the step before: an expression that is
    # named twice in a lambda is computed twice.
    def parts(body):
        rest = F.coalesce(F.get(body, F.lit(1)), F.lit(""))
        lyric = F.when(rest.contains("\n"), F.regexp_replace(rest, r"[ \t]*\n[ \t]*", "\n")).otherwise(rest)
        return F.struct(
            (F.size(body) > 1).alias("whole"), tx.trim(F.get(body, F.lit(0))).alias("timing"), tx.trim(lyric).alias("text")
        )

    def clocks(b):
        digits = F.split(F.regexp_replace(b["timing"], SRT_TIMING, "$1:$2:$3:$4:$5:$6:$7:$8"), ":")
        return F.struct(
            b["whole"].alias("whole"), F.when(b["timing"].rlike(SRT_TIMING), digits).alias("digits"),
            b["text"].alias("text"), tx.is_bracket_heading(b["text"]).alias("heading"),
        )

    def samples(b):
        sample = lambda n: clock.srt_samples_wide(*[F.get(b["digits"], F.lit(n + k)) for k in range(4)])
        return F.struct(
            b["whole"].alias("whole"), sample(0).alias("start"), sample(4).alias("end"), b["text"].alias("text"),
            b["heading"].alias("heading"),
        )

    blocks = F.transform(F.transform(F.transform(bodies, parts), clocks), samples)

    def why(b, i):
        before = F.get("_blocks", F.when(i > 0, i - 1))["end"]
        return (
            F.when(~b["whole"], "invalid_srt_block")
            .when(b["start"].isNull() | b["end"].isNull(), "invalid_lyric_timestamp")
            .when(b["text"] == "", "empty_lyric_cue")
            .when(b["end"] <= b["start"], "invalid_lyric_range")
            .when(b["end"] > F.col("duration_samples"), "lyrics_out_of_bounds")
            .when(before > b["start"], "overlapping_lyrics")
            .when(~b["heading"] & (F.length(b["text"]) > tx.MAX_LINE), "lyric_text_too_long")
        )

    rows = corpus.select(*keys, "duration_samples", blocks.alias("_blocks")).select(
        *keys,
        F.get(F.filter(F.transform("_blocks", why), lambda x: x.isNotNull()), F.lit(0)).alias("_why"),
        F.filter("_blocks", lambda b: ~b["heading"]).alias("_cues"),
        F.size(F.filter("_blocks", lambda b: b["heading"])).alias("_skipped"),
    )
    return rows.withColumn("_reason", F.coalesce("_why", F.when(F.size("_cues") == 0, "no_lyric_cues")))


def srt_cues(corpus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SRT documents (``text``, ``duration_samples``) to cues with their own ends.

    Headings are skipped but still count for the overlap test. A refused document has one
    row with the reason of its first refused block.
    """
    keys = list(keys)
    return _exploded(_parsed_srt(corpus, keys), keys)


def import_facts(corpus: DataFrame, keys: Sequence[str], form: str) -> DataFrame:
    """What the import of each document did: format, end_time_policy, offset_samples, skipped_stage_headings, reason.

    ``form`` is ``lrc`` or ``srt``; the facts of a refused document are null beside its
    reason. ``offset_samples`` is the last offset of an LRC document, null for SRT.
    """
    keys = list(keys)
    if form not in ("lrc", "srt"):
        raise ValueError("form must be lrc or srt")
    parsed = _parsed_lrc(corpus, keys) if form == "lrc" else _parsed_srt(corpus, keys)
    good = F.col("_reason").isNull()
    offset = F.col("_offset").try_cast("long") if form == "lrc" else F.lit(None).cast("long")
    policy = "next_start_or_song_end" if form == "lrc" else "explicit"
    return parsed.select(
        *keys, F.lit(form).alias("format"), F.lit(policy).alias("end_time_policy"),
        F.when(good, offset).alias("offset_samples"),
        F.when(good, F.col("_skipped")).cast("long").alias("skipped_stage_headings"),
        F.col("_reason").alias("reason"),
    )


def timed_chars(tokens: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Characters of each token's key with an even share of its span, in time order.

    ``tokens``: keys, token_idx, word, start, end (seconds), duration_samples.
    """
    keys = list(keys)
    span = clock.seconds_to_range("start", "end", F.col("duration_samples"))
    rows = (
        tokens.withColumn("_key", tx.norm_key("word"))
        .withColumn("_span", span)
        .where("_span is not null and _key <> ''")
        .withColumn("_n", F.length("_key").cast("long"))
        .select(
            *keys, "token_idx", "_span", "_n", F.posexplode(F.split("_key", "")).alias("_i", "char")
        )
    )
    width = F.col("_span.end_sample") - F.col("_span.start_sample")
    start = F.col("_span.start_sample") + int_div(width * F.col("_i"), F.col("_n"))
    stop = F.col("_span.start_sample") + int_div(width * (F.col("_i") + 1), F.col("_n"))
    chars = rows.select(
        *keys, "token_idx", F.col("_i").alias("char_idx"), "char", start.alias("start_sample"),
        F.greatest(start + 1, stop).alias("end_sample"),
    )
    order = ["start_sample", "end_sample", "token_idx", "char_idx"]
    return ordinal(chars, keys, order, int_div("start_sample", block), "pos")


def alignment_sizes(
    lines: DataFrame, chars: DataFrame, keys: Sequence[str], limited: bool = True
) -> DataFrame:
    """Characters on both sides per track; a reason where the alignment is refused.

    The limits are those of the import format; the alignment itself has none, and with
    ``limited=False`` no track is refused.
    """
    keys = list(keys)
    known = lines.groupBy(*keys).agg(F.sum(F.length("key")).alias("known_chars"))
    seen = chars.groupBy(*keys).agg(F.count("*").alias("observed_chars"))
    reason = F.when(F.col("known_chars") > MAX_KNOWN, "alignment_text_too_large").when(
        F.col("observed_chars") > MAX_OBSERVED, "alignment_evidence_too_large"
    )
    return known.join(seen, keys, "full").fillna(
        0, ["known_chars", "observed_chars"]
    ).withColumn("reason", reason if limited else F.lit(None).cast("string"))


def align_pairs(
    lines: DataFrame, chars: DataFrame, keys: Sequence[str], limited: bool = True, tile: int = TILE
) -> DataFrame:
    """Matched (known_pos, observed_pos) of the global alignment of each track.

    The table of costs is worked off in tiles of ``tile`` x ``tile`` characters (see
    :mod:`trackloom.operators.tiles`). Unless ``limited`` is off, tracks over the size
    limits are refused beforehand (``alignment_sizes``).
    """
    keys = list(keys)
    if limited:
        fits = alignment_sizes(lines, chars, keys).where("reason is null").select(*keys)
        lines, chars = salted_join(lines, fits, keys), salted_join(chars, fits, keys)
    return align_blocks(known_blocks(lines, keys, tile), observed_blocks(chars, keys, tile), keys, tile)


def line_coverage(
    lines: DataFrame,
    pairs: DataFrame,
    chars: DataFrame,
    tracks: DataFrame,
    keys: Sequence[str],
    limited: bool = True,
) -> DataFrame:
    """Matched characters of each line, coverage, status and the first time range.

    A line matches with at least 2 characters and 0.45 of its key; its range is at
    least 14400 samples long. Lines of a track that ``alignment_sizes`` refuses are
    unmatched with its reason.
    """
    keys = list(keys)
    refused = (
        alignment_sizes(lines, chars, keys, limited)
        .where("reason is not null")
        .select(*keys, F.col("reason").alias("_refused"))
    )
    sized = lines.withColumn("_n", F.length("key").cast("long"))
    edges = running_sum(
        sized, keys, ["line"], int_div("line", 1024), F.col("_n"), "end_sample"
    ).withColumn("start_sample", F.col("end_sample") - F.col("_n"))
    at = chars.select(*keys, F.col("pos").alias("observed_pos"), "start_sample", "end_sample")
    timed = pairs.join(at, [*keys, "observed_pos"])
    owned = owner_interval(timed, edges, keys, "known_pos", ["line"], 1024)
    hits = (
        owned.where("owner is not null")
        .groupBy(*keys, F.col("owner.line").alias("line"))
        .agg(
            F.count("*").alias("_hits"),
            F.min_by("start_sample", "known_pos").alias("_start"),
            F.max_by("end_sample", "known_pos").alias("_end"),
        )
    )
    rows = salted_join(
        sized.join(hits, [*keys, "line"], "left"),
        tracks.select(*keys, "duration_samples").join(refused, keys, "left"), keys,
    )
    count = F.coalesce("_hits", F.lit(0).cast("long"))
    enough = (count >= MIN_MATCHED) & (count / F.col("_n") >= MIN_COVERAGE)
    matched = F.col("_refused").isNull() & enough
    end = F.least(
        F.col("duration_samples"), F.greatest(F.col("_end"), F.col("_start") + MIN_CUE_SAMPLES)
    )
    return rows.select(
        *keys, "line", "text", F.col("_n").alias("normalized_characters"),
        F.when(matched, "matched").otherwise("unmatched").alias("status"),
        (count / F.col("_n")).alias("coverage"),
        F.when(matched, F.col("_start")).alias("start_sample"),
        F.when(matched, end).alias("end_sample"),
        F.when(~matched, F.coalesce("_refused", F.lit("insufficient_exact_character_matches"))).alias("reason"),
        "duration_samples",
    )


def repair_monotonic(mapped: DataFrame, keys: Sequence[str], block: int = 1024) -> DataFrame:
    """Clip a matched line to the next matched start, or unmatch it when time does not grow.

    Only later rows as they came are read, so this is one look ahead, not a loop.
    """
    keys = list(keys)
    found = mapped.where("status = 'matched'").select(*keys, "line", "start_sample")
    ahead = neighbour(
        found, keys, ["line"], int_div("line", block), ["start_sample"], "_ahead", 1
    ).select(*keys, "line", F.col("_ahead.start_sample").alias("_next"))
    rows = mapped.join(ahead, [*keys, "line"], "left")
    matched = F.col("status") == "matched"
    limit = F.coalesce("_next", "duration_samples")
    stuck = matched & (limit <= F.col("start_sample"))
    return rows.select(
        *[c for c in mapped.columns if c not in
          ("status", "start_sample", "end_sample", "reason", "duration_samples")],
        F.when(stuck, "unmatched").otherwise(F.col("status")).alias("status"),
        F.when(~stuck, F.col("start_sample")).alias("start_sample"),
        F.when(~stuck & matched, F.least("end_sample", limit)).alias("end_sample"),
        F.when(stuck, "non_increasing_mapped_time").otherwise(F.col("reason")).alias("reason"),
    )


def rank_values(
    df: DataFrame, keys: Sequence[str], value: str, block: int
) -> DataFrame:
    """Median (floor of the mean of the middle two) and nearest-rank P90, exact.

    Values are counted first; ranks then come from a running sum over value
    blocks, so a group of any size never meets in one task.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return _rank_counts(counts, list(keys), value, block)


def _rank_counts(counts: DataFrame, keys: list[str], value: str, block: int) -> DataFrame:
    """``rank_values`` of values that come with their number ``_n``."""
    ranked = running_sum(counts, keys, [value], int_div(value, block), F.col("_n"), "_upto")
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    n = F.col("_total")
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col(value)))
    low = at(int_div(n + 1, 2))
    high = at(int_div(n, 2) + 1)
    return (
        salted_join(ranked, totals, keys)
        .groupBy(*keys)
        .agg(
            F.max("_total").alias("count"),
            int_div(low + high, 2).alias("median"),
            at(int_div(9 * n + 9, 10)).alias("p90"),
        )
    )


def evaluate(
    lines: DataFrame, references: DataFrame, keys: Sequence[str], block: int = 4096
) -> DataFrame:
    """Absolute start errors against reference points, with the fixed pass gates.

    ``lines``: keys, line, start_sample (null when unmatched);
    ``references``: keys, line, reference_sample. A track whose reference points repeat a
    line, or start before 0 or nowhere, is not evaluated and says so. Both inputs are counted
    first: give stored tables, whose counts are in their files.
    """
    keys = list(keys)
    # Sides of many rows get as many tasks as their rows need, so that none holds more as they grow.
    tasks = tasks_for(max(references.count(), lines.count()), references.sparkSession)
    points = references.repartition(tasks, *keys, "line").groupBy(*keys, "line").agg(
        F.count("*").alias("_points"), F.min("reference_sample").alias("reference_sample"),
        F.max(F.coalesce(F.col("reference_sample") < 0, F.lit(True)) | F.col("line").isNull()).alias("_bad"),
    )
    starts = lines.select(*keys, "line", "start_sample").repartition(tasks, *keys, "line")
    rows = points.join(starts.hint("merge"), [*keys, "line"], "left")
    # All that follows reads the points counted by their error; it is null without a start or a reference.
    lost = F.col("start_sample").isNull()
    counted = materialize(
        rows.groupBy(*keys, F.abs(F.col("start_sample") - F.col("reference_sample")).alias("_error")).agg(
            F.count("*").alias("_n"), F.sum("_points").alias("_points"),
            F.coalesce(F.sum(F.when(lost, F.col("_points"))), F.lit(0)).alias("_lost"),
            F.max((F.col("_points") > 1) | F.col("_bad")).alias("_invalid"),
        )
    )
    counts = counted.groupBy(*keys).agg(
        F.sum("_points").alias("reference_points"), F.sum("_lost").alias("unmatched_reference_points"),
        F.max("_invalid").alias("_invalid"),
    )
    errors = counted.where("_error is not null").select(*keys, "_error", "_n")
    out = counts.join(_rank_counts(errors, keys, "_error", block), keys, "left")
    passed = (
        (F.col("unmatched_reference_points") == 0)
        & (F.col("median") <= GATE_MEDIAN) & (F.col("p90") <= GATE_P90)
    )
    reason = F.when(F.col("_invalid"), "invalid_reference_points").when(
        F.col("reference_points") < MIN_REFERENCES, "too_few_reference_points"
    ).when(F.col("count").isNull(), "no_matched_reference_point")
    return out.select(
        *keys, "reference_points",
        (F.col("reference_points") - F.col("unmatched_reference_points")).alias(
            "matched_reference_points"
        ),
        "unmatched_reference_points",
        F.when(~F.col("_invalid"), F.col("median")).alias("median_absolute_error_samples"),
        F.when(~F.col("_invalid"), F.col("p90")).alias("p90_absolute_error_samples"),
        F.coalesce(passed & ~F.col("_invalid"), F.lit(False)).alias("passed"),
        reason.alias("reason"),
    )


def edit_report(lines: DataFrame, edits: DataFrame, tracks: DataFrame, keys: Sequence[str],
                block: int = 1024) -> DataFrame:
    """What is wrong with a complete edit set: missing, extra, out of range, not increasing."""
    keys = list(keys)
    both = lines.select(*keys, "line", F.lit(True).alias("_known")).join(
        edits.select(*keys, "line", "start_sample"), [*keys, "line"], "full"
    )
    rows = salted_join(both, tracks.select(*keys, "duration_samples"), keys, "left")
    order = neighbour(
        edits.select(*keys, "line", "start_sample"), keys, ["line"], int_div("line", block),
        ["start_sample"], "_before", -1,
    ).where(F.col("_before.start_sample") >= F.col("start_sample"))
    reason = (
        F.when(F.col("start_sample").isNull(), "missing_edit")
        .when(F.col("_known").isNull(), "extra_edit")
        .when(
            (F.col("start_sample") < 0) | (F.col("start_sample") >= F.col("duration_samples")),
            "edit_out_of_range",
        )
    )
    return (
        rows.select(*keys, "line", reason.alias("reason"))
        .where("reason is not null")
        .unionByName(order.select(*keys, "line", F.lit("edit_not_increasing").alias("reason")))
    )


def apply_edits(lines: DataFrame, edits: DataFrame, tracks: DataFrame, keys: Sequence[str],
                block: int = 1024) -> DataFrame:
    """Cues of the tracks whose edit set is complete and increasing: end = next start or track end."""
    keys = list(keys)
    bad = edit_report(lines, edits, tracks, keys, block).select(*keys).distinct()
    good = edits.join(bad, keys, "left_anti")
    starts = neighbour(
        good.select(*keys, "line", "start_sample"), keys, ["line"], int_div("line", block),
        ["start_sample"], "_after", 1,
    )
    cues = salted_join(starts, tracks.select(*keys, "duration_samples"), keys)
    return cues.join(lines.select(*keys, "line", "text"), [*keys, "line"]).select(
        *keys, "line", "start_sample",
        F.coalesce("_after.start_sample", "duration_samples").alias("end_sample"), "text",
    )


def active_cue(points: DataFrame, cues: DataFrame, keys: Sequence[str], block: int,
               fields: Sequence[str] = ("cue_idx", "start_sample", "end_sample")) -> DataFrame:
    """Cue that is on at each point, else null."""
    return owner_interval(points, cues, keys, "sample", list(fields), block, name="cue")


def pick_audio(tracks: DataFrame, stems: DataFrame) -> DataFrame:
    """Vocals part when it exists and is verified, else the whole track.

    ``stems``: track_id, sha256, source_sha256, actual_sha256. A stem that exists
    but fails a check is reported, not silently replaced.
    """
    rows = tracks.select("track_id", "sha256").join(
        stems.select(
            "track_id", F.col("sha256").alias("_stem"), "source_sha256", "actual_sha256"
        ),
        "track_id", "left",
    )
    bad = F.col("_stem").isNotNull() & ~(
        F.col("source_sha256").eqNullSafe(F.col("sha256"))
        & F.col("actual_sha256").eqNullSafe(F.col("_stem"))
    )
    return rows.select(
        "track_id",
        F.when(F.col("_stem").isNull(), "canonical").otherwise("vocals").alias("audio_source"),
        F.coalesce("_stem", "sha256").alias("audio_sha256"),
        F.when(bad, "invalid_vocals_stem").alias("reason"),
    )

