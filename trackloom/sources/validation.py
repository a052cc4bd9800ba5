"""The rules inside one document of a kind, as one array expression: no shuffle, all violations at once.

The same rules over tables, where the parts of a track are many rows, are in
:mod:`trackloom.operators.rules`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.operators.rules import NAME, PROFILES, SHA256

# Limits and closed lists of the stored documents.
MAX_INT = 2**53 - 1
SAMPLE_RATE = 48_000
ORIGINS = ("automatic", "manual")
POLICIES = ("require-empty", "replace")
MODES = {"abstract": ("abstract",), "mood": ("media",), "hybrid": ("abstract", "media")}
CATEGORIES = ("abstract", "media", "text")
TRANSFORMS = ("linear", "threshold", "smooth")
LYRIC_MODES = ("off", "imported", "auto")


def _any(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(items, test), F.lit(False))


def _neighbours(items: Column, test: Callable[[Column, Column], Column]) -> Column:
    """True when ``test`` holds for an item and the next one."""
    after = F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1)))
    pairs = F.zip_with(items, after, lambda a, b: F.when(b.isNotNull(), test(a, b)))
    return _any(pairs, lambda x: x)


def _repeated(values: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(values)) < F.size(values), F.lit(False))


def _of(items: Column, name: str) -> Column:
    return F.transform(items, lambda x: x[name])


def _no_name(text: Column) -> Column:
    return ~text.rlike(NAME)


def _no_unit(value: Column) -> Column:
    return (value < 0) | (value > 1)


def _no_count(value: Column, least: int = 0) -> Column:
    return (value < least) | (value > MAX_INT)


def _bad_range(r: Column) -> Column:
    return _no_count(r["start_sample"]) | _no_count(r["end_sample"], 1) | (r["end_sample"] <= r["start_sample"])


def _overlap(items: Column) -> Column:
    return _neighbours(items, lambda a, b: a["end_sample"] > b["start_sample"])


def _gap(items: Column) -> Column:
    return _neighbours(items, lambda a, b: a["end_sample"] != b["start_sample"])


def _bad_source(s: Column) -> Column:
    return (
        ~s["sha256"].rlike(SHA256) | (s["sample_rate"] != SAMPLE_RATE) | _no_count(s["duration_samples"], 1) | (s["path"] == "")
    )


def _timeline(d: Callable[[str], Column]) -> dict[str, Column]:
    duration, signals = d("source")["duration_samples"], F.map_values(d("signals"))
    events, sections = d("events"), d("sections")
    start = lambda s: F.coalesce(s["start_sample"], F.lit(0))
    last = lambda s: start(s).cast("decimal(38,0)") + (F.size(s["values"]) - 1).cast("long") * s["hop_samples"]
    return {
        "invalid_source": _bad_source(d("source")),
        "invalid_signal": _any(
            signals, lambda s: _no_count(start(s)) | _no_count(s["hop_samples"], 1) | (F.size(s["values"]) == 0) | (s["unit"] == "")
        ) | _any(F.map_keys(d("signals")), _no_name),
        "signal_outside_track": _any(signals, lambda s: last(s) >= duration),
        "invalid_event": _any(
            events, lambda e: _no_name(e["name"]) | _no_name(e["source"]) | _no_count(e["sample"])
        ) | _any(events, lambda e: _no_unit(e["confidence"])),
        "event_outside_track": _any(events, lambda e: e["sample"] >= duration),
        "events_unordered": _neighbours(events, lambda a, b: a["sample"] > b["sample"]),
        "invalid_section": _any(sections, lambda s: _bad_range(s) | _no_name(s["id"]) | ~s["origin"].isin(*ORIGINS))
        | _any(sections, lambda s: (s["label"] == "") | _no_unit(s["confidence"])) | _any(sections, lambda s: _no_unit(s["confidence"])),
        "duplicate_section": _repeated(_of(sections, "id")),
        "sections_overlap": _overlap(sections),
        "section_outside_track": _any(sections, lambda s: s["end_sample"] > duration),
    }


def _structure(d: Callable[[str], Column]) -> dict[str, Column]:
    duration, beats, bounds, groups = d("source")["duration_samples"], d("beat_samples"), d("boundaries"), d("repeated_groups")
    spans = F.flatten(_of(groups, "spans"))
    anchors = F.concat(F.array(F.lit(0).cast("long")), beats, F.array(duration))
    known = F.concat(F.array(F.lit("novelty")), _of(groups, "id"))
    rising = lambda values: _neighbours(values, lambda a, b: a >= b)
    return {
        "invalid_source": _bad_source(d("source")) | ~d("cache_key").rlike(SHA256),
        "beats_unordered": rising(beats),
        "invalid_beat": _any(beats, lambda x: _no_count(x, 1)),
        "beat_outside_track": _any(beats, lambda x: x >= duration),
        "invalid_boundary": _any(
            bounds, lambda b: _no_name(b["id"]) | _no_count(b["sample"], 1) | _no_unit(b["confidence"])
            | (F.size(b["sources"]) == 0) | _repeated(b["sources"])
        ),
        "duplicate_boundary": _repeated(_of(bounds, "id")),
        "boundaries_unordered": rising(_of(bounds, "sample")),
        "boundary_outside_track": _any(bounds, lambda b: b["sample"] >= duration),
        "unknown_evidence": _any(bounds, lambda b: F.size(F.array_except(b["sources"], known)) > 0),
        "duplicate_group": _repeated(_of(groups, "id")),
        "invalid_group": _any(
            groups, lambda g: _no_name(g["id"]) | _no_unit(g["confidence"]) | (F.size(g["spans"]) < 2)
            | _repeated(_of(g["spans"], "id")) | _any(g["spans"], lambda s: s["group_id"] != g["id"])
        ),
        "spans_overlap": _any(groups, lambda g: _overlap(g["spans"])),
        "invalid_span": _any(
            spans, lambda s: _bad_range(s) | _no_name(s["id"]) | _no_unit(s["confidence"])
            | _no_count(s["start_anchor_index"]) | (s["end_anchor_index"] <= s["start_anchor_index"])
        ),
        "span_outside_track": _any(spans, lambda s: s["end_sample"] > duration),
        "span_off_its_anchors": _any(
            spans,
            lambda s: ~F.get(anchors, s["start_anchor_index"].cast("int")).eqNullSafe(s["start_sample"])
            | ~F.get(anchors, s["end_anchor_index"].cast("int")).eqNullSafe(s["end_sample"]),
        ),
    }


def _selection(d: Callable[[str], Column]) -> dict[str, Column]:
    sections = d("sections")
    return {
        "not_reviewed": ~d("reviewed"),
        "unknown_policy": ~d("existing_sections_policy").isin(*POLICIES),
        "no_sections": F.size(sections) == 0,
        "invalid_section": _any(sections, lambda s: _bad_range(s) | _no_name(s["id"])),
        "duplicate_section": _repeated(_of(sections, "id")),
        "sections_overlap": _overlap(sections),
        "sections_not_contiguous": _gap(sections),
    }


def _bad_output(output: Column) -> Column:
    """A profile field may be left out; those given must be of one profile."""
    names = ("width", "height", "fps_num", "fps_den")
    fits = F.lit(False)
    for profile in PROFILES:
        one = F.lit(True)
        for name, value in zip(names, profile, strict=True):
            one &= F.coalesce(output[name] == value, F.lit(True))
        fits |= one
    return output.isNotNull() & ~fits


def _bad_layer(x: Column) -> Column:
    return (
        _no_name(x["id"]) | _no_name(x["kind"]) | ~x["category"].isin(*CATEGORIES)
        | F.coalesce(_no_unit(x["opacity"]), F.lit(False)) | ((x["category"] == "media") & x["asset_id"].isNull())
    )


def _bad_lyrics(lyrics: Column) -> Column:
    mode = F.coalesce(lyrics["mode"], F.lit("off"))
    off = mode == "off"
    return ~mode.isin(*LYRIC_MODES) | (off != lyrics["path"].isNull()) | (off != lyrics["font_asset_id"].isNull())


def _bad_route(r: Column) -> Column:
    names = _no_name(r["source"]) | _no_name(r["target_layer"]) | _no_name(r["target_parameter"])
    return names | ~r["transform"]["kind"].isin(*TRANSFORMS)


def _plan(d: Callable[[str], Column]) -> dict[str, Column]:
    layers, routes, sections, mode = d("layers"), d("routes"), d("sections"), d("mode")
    ids = _of(layers, "id")
    shown = F.array_distinct(_of(F.filter(layers, lambda x: F.coalesce(x["enabled"], F.lit(True))), "category"))
    lacks, mixed = F.lit(False), F.lit(False)
    for name, needed in MODES.items():
        for category in needed:
            lacks |= (mode == name) & ~F.array_contains(shown, category)
        if len(needed) == 1:
            other = "media" if needed[0] == "abstract" else "abstract"
            mixed |= (mode == name) & F.array_contains(shown, other)
    return {
        "unknown_mode": ~mode.isin(*MODES),
        "invalid_seed": _no_count(d("seed")),
        "invalid_output": _bad_output(d("output")),
        "no_layers": F.size(layers) == 0,
        "invalid_layer": _any(layers, _bad_layer),
        "duplicate_layer": _repeated(ids),
        "mode_lacks_category": lacks,
        "mode_excludes_category": mixed,
        "invalid_route": _any(routes, _bad_route),
        "route_to_unknown_layer": _any(routes, lambda r: ~F.array_contains(ids, r["target_layer"])),
        "duplicate_override": _repeated(_of(sections, "section_id")) | _any(sections, lambda s: _repeated(_of(s["layers"], "layer_id"))),
        "override_of_unknown_layer": _any(
            sections, lambda s: _any(s["layers"], lambda x: ~F.array_contains(ids, x["layer_id"]))
        ),
        "invalid_lyrics": _bad_lyrics(d("lyrics")),
    }


def _resolved(d: Callable[[str], Column]) -> dict[str, Column]:
    spans, routes, duration = d("spans"), d("routes"), d("duration_samples")
    first = F.array_sort(_of(F.get(spans, F.lit(0))["layers"], "id"))
    off = F.coalesce(d("lyrics")["mode"], F.lit("off")) == "off"
    return {
        "invalid_seed": _no_count(d("seed")),
        "invalid_output": _bad_output(d("output")),
        "no_spans": F.size(spans) == 0,
        "invalid_span": _any(
            spans, lambda s: _bad_range(s) | (F.size(s["layers"]) == 0) | _repeated(_of(s["layers"], "id"))
            | _any(s["layers"], _bad_layer) | (s["section_id"].isNull() != s["section_origin"].isNull())
            | (F.coalesce(s["transition_samples"], F.lit(0)) > s["end_sample"] - s["start_sample"])
        ),
        "spans_overlap": _overlap(spans),
        "spans_not_contiguous": _gap(spans),
        "track_not_covered": (F.get(spans, F.lit(0))["start_sample"] != 0)
        | (F.get(spans, F.size(spans) - 1)["end_sample"] != duration),
        "layers_differ": _any(spans, lambda s: F.array_sort(_of(s["layers"], "id")) != first),
        "invalid_route": _any(routes, _bad_route),
        "route_to_unknown_layer": _any(routes, lambda r: ~F.array_contains(first, r["target_layer"])),
        "invalid_lyrics": _bad_lyrics(d("lyrics")) | (off != d("lyrics_sha256").isNull()),
    }


RULES = {
    "timeline": _timeline, "structure": _structure, "structure-selection": _selection, "plan": _plan, "resolved-plan": _resolved,
}


def violations(artifact: str, kind: str, shape) -> Column:
    """Codes of the rules that a parsed document (struct column ``artifact``) breaks; kinds without rules break none.

    A list or map that is left out counts as empty.
    """

    def field(name: str) -> Column:
        column = F.col(f"{artifact}.{name}")
        text = shape[name].dataType.simpleString()
        if text.startswith("array"):
            return F.coalesce(column, F.array().cast(text))
        return F.coalesce(column, F.create_map().cast(text)) if text.startswith("map") else column

    if kind not in RULES:
        return F.array().cast("array<string>")
    found = [F.when(broken, F.lit(code)) for code, broken in RULES[kind](field).items()]
    return F.array_compact(F.array(*found))
