"""License scans by template-markup matching.

A template is wording with optional regions ``[ ... ]`` and replaceable regions
``{m,n}`` (m to n words of any kind). It is compiled into a token automaton, which
accepts a place of a text where all mandatory words stand as written, whatever lies
between the words. The base phrases are templates without markup. A template is tried
only on texts that contain its rarest mandatory word, and only from places of its first
words; both are consequences of exact wording, so no place is lost.

Cases: a null text is empty. Texts without words have no places. Repeated rows get the
same answer; other columns are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.shingles import text_buffers

BASE = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
# The wording of well-known licence notices.
NOTICES = {
    "gpl-3.0": "gnu general public license [as published by the free software foundation] [either] [v] [version] 3",
    "gpl-2.0": "gnu general public license [as published by the free software foundation] [either] [v] [version] 2",
    "apache-2.0": "licensed under the apache license [version] 2 [0]",
    "cc-by-4.0": "[licensed under] cc by 4 0",
    "cc-by-sa-4.0": "[licensed under] cc by sa 4 0",
    "cc-by-nc-4.0": "[licensed under] cc by nc 4 0",
    "mit-notice": "[released] [licensed] [distributed] under the [terms of the] mit license",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "[and associated documentation files] [the software] to deal in {1,4} without restriction"
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "[provided that the following conditions are met]"
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee "
        "is hereby granted [provided that the above copyright notice and this permission notice appear in all copies]"
    ),
}
ANY = None
_WORD = np.ones(256, dtype=bool)
_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARKUP = re.compile(r"\[|\]|\{\d+,\d+\}|[^\s\[\]{}]+")


@dataclass
class Automaton:
    """``moves[s]``: (word or ANY, next state); state ``end`` accepts."""

    label: str
    moves: list[list[tuple[bytes | None, int]]] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    end: int = 0
    firsts: frozenset[bytes] = frozenset()
    rarest: bytes = b""

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def accepts(self, words: list[bytes], at: int) -> int:
        """The number of words of the longest accepted place from ``at``; 0 for none."""
        states, longest = self.closure({0}), 0
        for n, word in enumerate(words[at:], 1) if at else enumerate(words, 1):
            states = self.closure({t for s in states for w, t in self.moves[s] if w is ANY or w == word})
            if not states:
                break
            if self.end in states:
                longest = n
        return longest


def compile_template(label: str, template: str) -> Automaton:
    """Regions nest; a region before or between words may be left out as a whole."""
    out = Automaton(label)

    def state() -> int:
        out.moves.append([])
        out.skips.append([])
        return len(out.moves) - 1

    now, opened, mandatory = state(), [], []
    for part in MARKUP.findall(template):
        if part == "[":
            opened.append(now)
        elif part == "]":
            start = opened.pop()
            after = state()
            out.skips[now].append(after)
            out.skips[start].append(after)
            now = after
        elif part[0] == "{":
            low, high = map(int, part[1:-1].split(","))
            skipped = []
            for k in range(high):
                if k >= low:
                    skipped.append(now)
                after = state()
                out.moves[now].append((ANY, after))
                now = after
            for s in skipped:
                out.skips[s].append(now)
        else:
            word, after = part.encode(), state()
            out.moves[now].append((word, after))
            now = after
            if not opened:
                mandatory.append(word)
    if opened or not mandatory:
        raise ValueError(f"template {label}: open region or no mandatory word")
    out.end = now
    out.rarest = max(mandatory, key=len) if len(max(mandatory, key=len)) > 2 else b" ".join(mandatory[:1])
    firsts = {w for s in out.closure({0}) for w, _ in out.moves[s]}
    if ANY in firsts:
        raise ValueError(f"template {label} starts with a replaceable region")
    out.firsts = frozenset(firsts)
    return out


def count_words(column) -> np.ndarray:
    """Words of every text."""
    data, offsets = text_buffers(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    row = 0
    while row < len(out):
        stop = int(np.searchsorted(offsets, offsets[row] + (1 << 22), side="right")) - 1
        stop = min(len(out), max(row + 1, stop))
        lo, hi = offsets[row], offsets[stop]
        inside = _WORD[_LOWER[data[lo:hi]]]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = offsets[row:stop] - lo
        starts = starts[starts < hi - lo]
        first[starts] = inside[starts]
        total = np.concatenate([[0], np.cumsum(first)])
        out[row:stop] = np.diff(total[offsets[row : stop + 1] - lo])
        row = stop
    return out


def scan_text(raw: bytes, base: list[Automaton], own: list[Automaton]) -> tuple | None:
    """(places of base phrases, first, last, base labels, labels, score) of a lowered text; None for nothing."""
    tried = [(a, True) for a in base if a.rarest in raw] + [(a, False) for a in own if a.rarest in raw]
    if not tried:
        return None
    words = WORD.findall(raw)
    where: dict[bytes, list[tuple[Automaton, bool]]] = {}
    for a, is_base in tried:
        for w in a.firsts:
            where.setdefault(w, []).append((a, is_base))
    places: list[int] = []
    labels: tuple[set, set] = (set(), set())
    for i, word in enumerate(words):
        for a, is_base in where.get(word, ()):
            if a.accepts(words[i : i + 64], 0):
                labels[is_base].add(a.label)
                if is_base:
                    places.append(i)
    if not (labels[0] or labels[1]):
        return None
    return (
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(labels[1])),
        ",".join(sorted(labels[0] | labels[1])),
        1.0 if labels[0] else 0.5,
    )


NOTHING = (0, None, None, "", "", 0.0)


def _scanner(base_texts: dict[str, str], own_texts: dict[str, str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [compile_template(*x) for x in base_texts.items()]
        own = [compile_template(*x) for x in own_texts.items()]
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            low = _LOWER[data]
            rows = [
                scan_text(low[a:b].tobytes(), base, own) or NOTHING
                for a, b in zip(offsets[:-1], offsets[1:], strict=True)
            ]
            n_base, first, last, base_labels, labels, sure = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(count_words(batch.column("text"))),
                    *(pa.array(x, pa.int64()) for x in (n_base, first, last)),
                    pa.array(base_labels, pa.string()),
                    pa.array(labels, pa.string()),
                    pa.array(sure, pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return scan


def scan_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] = BASE,
    notices: dict[str, str] = NOTICES,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    ``score`` is 1 for the wording of a notice, 0.5 for base phrases alone, 0 for neither.
    """
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(
        df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")
    ).mapInArrow(
        _scanner(base, notices),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double",
    )
