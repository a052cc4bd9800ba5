"""Global alignment of two long texts by tiles of the cost table.

The cost table of a track is cut into tiles. Tiles on one anti-diagonal depend only on the
anti-diagonal before, so a wave computes all of them in parallel, for all tracks at once:
a tile reads the last row of the tile above and the last column of the tile to its left and
hands on its own. The way back visits the waves in reverse and recomputes only the one tile
of each track that the path crosses, from the borders stored on the way forth. No task
holds more of a track than one tile's texts and borders; waves are as many as the longest
track has tiles along both sides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.blocks import int_div, running_sum
from trackloom.sources.tables import materialize

TILE = 8192
STRIP = 256
DIAGONAL, DELETE, INSERT = 0, 1, 2


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)


def _next_row(cost: np.ndarray, left: int, same: np.ndarray, steps: np.ndarray, ways: np.ndarray | None) -> np.ndarray:
    """Costs of a row from the row above and its own cost at the left border; ties: diagonal, delete, insert."""
    diagonal, delete = cost[:-1] + ~same, cost + 1
    best = delete.copy()
    np.minimum(diagonal, delete[1:], out=best[1:])
    best[0] = left
    best = np.minimum.accumulate(best - steps) + steps
    if ways is not None:
        ways[:] = np.where(diagonal == best[1:], DIAGONAL, np.where(delete[1:] == best[1:], DELETE, INSERT))
    return best


def tile_forward(a: np.ndarray, b: np.ndarray, top: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bottom, right) borders of a tile, corners included."""
    steps = np.arange(len(b) + 1, dtype=np.int32)
    right, cost = np.empty(len(a) + 1, dtype=np.int32), top
    right[0] = top[-1]
    for row in range(len(a)):
        cost = _next_row(cost, left[row + 1], b == a[row], steps, None)
        right[row + 1] = cost[-1]
    return cost, right


def tile_path(
    a: np.ndarray, b: np.ndarray, top: np.ndarray, left: np.ndarray, r: int, c: int
) -> tuple[list[int], list[int], int, int]:
    """Matches on the way back from cell (r, c) to the tile's upper or left border, and where it is reached.

    Only every ``STRIP``-th row of costs is kept; directions are rebuilt strip by strip.
    """
    a, b = a[:r], b[:c]
    steps = np.arange(c + 1, dtype=np.int32)
    saved, cost = [], top[: c + 1]
    for row in range(r):
        if row % STRIP == 0:
            saved.append(cost)
        cost = _next_row(cost, left[row + 1], b == a[row], steps, None)
    known, observed = [], []
    for number in range(len(saved) - 1, -1, -1):
        first, last = number * STRIP, min(r, number * STRIP + STRIP)
        ways, cost = np.empty((last - first, len(b)), dtype=np.int8), saved[number]
        for row in range(first, last):
            cost = _next_row(cost, left[row + 1], b == a[row], steps, ways[row - first])
        while r > first and c > 0:
            way = ways[r - 1 - first, c - 1]
            if way == DIAGONAL and a[r - 1] == b[c - 1]:
                known.append(r - 1)
                observed.append(c - 1)
            r -= way != INSERT
            c -= way != DELETE
        if c == 0:
            break
    return known, observed, r, c


def known_blocks(lines: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """keys, _i, _a: the texts of ``key`` in the order of ``line``, one after another, cut every ``tile`` characters."""
    sized = lines.select(*keys, "line", "key", F.length("key").cast("long").alias("_n")).where("_n > 0")
    placed = running_sum(sized, keys, ["line"], int_div("line", 1024), F.col("_n"), "_stop").withColumn(
        "_start", F.col("_stop") - F.col("_n")
    )
    low = F.greatest(F.col("_start"), F.col("_i") * tile)
    pieces = placed.withColumn(
        "_i", F.explode(F.sequence(int_div("_start", tile), int_div(F.col("_stop") - 1, tile)))
    ).select(
        *keys, "_i", low.alias("_at"),
        F.substring(F.col("key"), low - F.col("_start") + 1, F.least("_stop", (F.col("_i") + 1) * tile) - low).alias("_text"),
    )
    return _joined(pieces, keys, "_i", "_a")


def observed_blocks(chars: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """keys, _j, _b: the characters by ``pos`` (from 0, without gaps), cut every ``tile`` characters."""
    pieces = chars.select(
        *keys, int_div("pos", tile).alias("_j"), F.col("pos").alias("_at"), F.col("char").alias("_text")
    )
    return _joined(pieces, keys, "_j", "_b")


def _joined(pieces: DataFrame, keys: Sequence[str], place: str, name: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("_at", "_text")))
    return pieces.groupBy(*keys, place).agg(F.array_join(ordered["_text"], "").alias(name))


def _column(arrays: list[np.ndarray | None]) -> list[bytes | None]:
    return [None if x is None else np.ascontiguousarray(x, dtype="<i4").tobytes() for x in arrays]


def _border(raw, base: int, length: int) -> np.ndarray:
    """A stored border, or that of the table's edge: ``base``, ``base`` + 1, ..."""
    if raw is None:
        return np.arange(base, base + length + 1, dtype=np.int32)
    return np.frombuffer(raw, dtype="<i4")


def align_blocks(known: DataFrame, observed: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """keys, known_pos, observed_pos: exact matches on the path of least cost of every track.

    ``known`` and ``observed`` are results of :func:`known_blocks` and :func:`observed_blocks`.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in known.schema}
    key_ddl = ", ".join(f"{k} {types[k]}" for k in keys)
    known, observed = materialize(known), materialize(observed)
    sizes = known.groupBy(*keys).agg((F.max("_i") + 1).alias("_rows")).join(
        observed.groupBy(*keys).agg((F.max("_j") + 1).alias("_cols")), keys
    )
    sizes = materialize(sizes)
    last = sizes.agg(F.max(F.col("_rows") + F.col("_cols"))).first()[0]
    sized = known.join(sizes, keys)

    tile_fields = ["_i", "_j", "_rows", "_cols", "_a", "_b", "_top", "_left"]
    stored = [*keys, *tile_fields, "_bottom", "_right"]
    stored_ddl = (
        f"{key_ddl}, _i bigint, _j bigint, _rows bigint, _cols bigint, _a string, _b string, "
        "_top binary, _left binary, _bottom binary, _right binary"
    )

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bottoms, rights = [], []
            for row in batch[tile_fields].itertuples(index=False, name=None):
                i, j, rows, cols, a, b, top, left = row
                if i == rows - 1 and j == cols - 1:  # nobody reads the borders of the last tile
                    bottoms.append(None)
                    rights.append(None)
                    continue
                a, b = _codes(a), _codes(b)
                bottom, right = tile_forward(a, b, _border(top, j * tile, len(b)), _border(left, i * tile, len(a)))
                bottoms.append(bottom)
                rights.append(right)
            yield batch.assign(_bottom=_column(bottoms), _right=_column(rights))[stored]

    back_ddl = (
        f"{key_ddl}, known_at array<bigint>, observed_at array<bigint>, _i bigint, _j bigint, _r bigint, _c bigint"
    )

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch[[*tile_fields, "_r", "_c"]].itertuples(index=False, name=None):
                i, j, _, _, a, b, top, left, r, c = row
                a, b = _codes(a), _codes(b)
                r, c = (len(a), len(b)) if pd.isna(r) else (int(r), int(c))
                top, left = _border(top, j * tile, len(b)), _border(left, i * tile, len(a))
                at, seen, r, c = tile_path(a, b, top, left, r, c)
                # The border cell belongs to the tile above, to the left, or to both at a corner.
                up, over = r == 0, c == 0
                found.append(
                    ([i * tile + x for x in at], [j * tile + x for x in seen], i - up, j - over,
                     tile if up else r, tile if over else c)
                )
            names = ["known_at", "observed_at", "_i", "_j", "_r", "_c"]
            columns = dict(zip(names, zip(*found, strict=True), strict=True)) if found else {n: [] for n in names}
            yield batch[keys].assign(**{n: list(c) for n, c in columns.items()})

    waves: list[DataFrame] = []
    for d in range((last or 1) - 1):
        tiles = sized.withColumn("_j", F.lit(d) - F.col("_i")).where("_j >= 0 and _j < _cols").join(observed, [*keys, "_j"])
        if waves:
            before = waves[-1]
            tiles = tiles.join(
                before.select(*keys, (F.col("_i") + 1).alias("_i"), "_j", F.col("_bottom").alias("_top")), [*keys, "_i", "_j"], "left"
            ).join(
                before.select(*keys, "_i", (F.col("_j") + 1).alias("_j"), F.col("_right").alias("_left")), [*keys, "_i", "_j"], "left"
            )
        else:
            tiles = tiles.withColumns({"_top": F.lit(None).cast("binary"), "_left": F.lit(None).cast("binary")})
        waves.append(materialize(tiles.select(*keys, *tile_fields).mapInPandas(forward, stored_ddl)))

    paths: list[DataFrame] = []
    for d in range(len(waves) - 1, -1, -1):
        tiles = waves[d].select(*keys, *tile_fields)
        crossings = [
            p.where((F.col("_i") >= 0) & (F.col("_j") >= 0) & (F.col("_i") + F.col("_j") == d)).select(*keys, "_i", "_j", "_r", "_c")
            for p in paths[-2:]
        ]
        if crossings:
            tiles = tiles.join(reduce(DataFrame.union, crossings), [*keys, "_i", "_j"], "left")
        else:
            tiles = tiles.withColumns({"_r": F.lit(None).cast("long"), "_c": F.lit(None).cast("long")})
        crossed = tiles.where("_r is not null or (_i = _rows - 1 and _j = _cols - 1)")
        paths.append(materialize(crossed.mapInPandas(back, back_ddl)))

    if not paths:
        empty = sizes.select(*keys, F.lit(0).cast("long").alias("known_pos"), F.lit(0).cast("long").alias("observed_pos"))
        return empty.where("false")
    return (
        reduce(DataFrame.union, paths)
        .select(*keys, F.explode(F.arrays_zip("known_at", "observed_at")).alias("_p"))
        .select(*keys, F.col("_p.known_at").alias("known_pos"), F.col("_p.observed_at").alias("observed_pos"))
    )
