"""Vector best-fit packing of token sequences.

A document is its ids and an end id; longer ones than a sequence are cut, the first
piece taking the remainder. Pieces that fill a sequence are done. The others are
dealt by hash to groups of a bounded number of pieces; in each group, longest first,
a piece goes into an open sequence that has room in every dimension (tokens, number of
documents, attention cost = squared length). Among these the one with the smallest
weighted norm of what stays free is taken, or the one with the largest weighted
dot-product of demand and free room; a new one is opened only if none has room.

Only one row per piece is moved, never ids or texts.

Cases: a null or empty text is one end id. Null ids are allowed and repeated rows are
packed each on its own. A single piece that breaks the attention limit alone gets a
sequence of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackloom.sources.tables import materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LENGTH = 2048
END_ID = 0
GROUP_PIECES = 8_192
CACHE_WORDS = 300_000

# The tokenizer's own splitting, fixed by its vocabulary, as far as Python's classes agree
# with it. Texts with other characters, or with the text of a special token, go through the
# tokenizer whole.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PLAIN = frozenset(map(chr, [*range(0x1C), *range(0x20, 0xB2), *range(0xB4, 0xB9), 0xBA, 0xBB, *range(0xBF, 0x250)]))
PLAIN |= frozenset(map(chr, range(0x2010, 0x2028)))
SPECIAL = "<|endoftext|>"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow 255."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Ids(dict):
    """Word to its ids as little-endian unsigned 32-bit bytes, filled as words come; bounded by ``of``."""

    def __init__(self, path: str = TOKENIZER):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        shown = word.encode().decode("latin-1").translate(self.letters)
        found = self[word] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found

    def of(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if not PLAIN.issuperset(set(text)) or SPECIAL in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, WORDS.findall(text)))


@lru_cache(maxsize=1)
def _ids(path: str) -> Ids:
    """One tokenizer and cache for each Python worker."""
    return Ids(path)


def _cutter(length: int, end_id: int, path: str):
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        for batch in batches:
            rows, out = batch.num_rows, []
            for at in range(0, rows, 64):
                for i, text in enumerate(batch.column("text").slice(at, 64).to_pylist()):
                    data = ids.of(text or "") + end
                    n = len(data) // 4
                    start, piece = 0, 0
                    while start < n:
                        size = (n - 1) % length + 1 if start == 0 else length
                        crc = zlib.crc32(memoryview(data)[4 * start : 4 * (start + size)])
                        out.append((at + i, piece, start, size, crc))
                        start, piece = start + size, piece + 1
            row, piece, start, size, crc = map(np.array, zip(*out, strict=True)) if out else [np.zeros(0, int)] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    *(pa.array(x.astype(np.int64)) for x in (start, size, crc)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return pieces


def best_fit(
    lengths: np.ndarray, limits: tuple[int, int, int], weights: tuple[float, float, float], score: str = "norm"
) -> np.ndarray:
    """The sequence of every piece, for pieces of falling length. limits: tokens, documents, attention cost."""
    capacity = np.array(limits, dtype=np.float64)
    weight = np.array(weights, dtype=np.float64)
    demand = np.column_stack([lengths, np.ones(len(lengths)), np.square(lengths, dtype=np.float64)]) / capacity
    free = np.zeros((256, 3))
    number = np.zeros(256, dtype=np.int64)
    opened, bins = 0, 0
    out = np.zeros(len(lengths), dtype=np.int64)
    least = demand.min(axis=0) if len(lengths) else np.zeros(3)
    eps = 1e-12
    for i, need in enumerate(demand):
        room = free[:opened] - need
        fits = np.flatnonzero((room >= -eps).all(axis=1))
        if len(fits):
            if score == "norm":
                best = fits[np.argmin(np.square(room[fits]) @ weight)]
            else:
                best = fits[np.argmax(free[fits] @ (weight * need))]
            free[best] = room[best]
            out[i] = number[best]
            if (free[best] < least - eps).any():  # nothing fits any more
                opened -= 1
                free[best], number[best] = free[opened], number[opened]
        else:
            if opened == len(free):
                free, number = np.vstack([free, np.zeros_like(free)]), np.concatenate([number, number * 0])
            out[i] = bins
            if not (1 - need < least - eps).any():
                free[opened], number[opened] = 1 - need, bins
                opened += 1
            bins += 1
    return out


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    score: str = "norm",
    end_id: int = END_ID,
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``max_documents`` and ``max_attention`` are open (``length`` and its square) by
    default, so that only the token limit binds.
    """
    limits = (length, max_documents or length, max_attention or length * length)
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))
    pieces = materialize(
        docs.mapInArrow(
            _cutter(length, end_id, tokenizer),
            f"doc_id {kind}, piece int, start long, length long, ids_crc32 long",
        )
    )
    whole = (F.col("length") == length) & F.lit(limits[2] >= length * length)
    partial = pieces.where(~whole).withColumn("draw", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()))
    groups = max(1, -(-partial.count() // GROUP_PIECES))
    partial = partial.withColumn("group", F.pmod("draw", F.lit(groups)).cast("int"))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        part["bin"] = best_fit(part["length"].to_numpy(), limits, weights, score)
        part["offset"] = part.groupby("bin")["length"].cumsum() - part["length"]
        part["sequence_id"] = part["group"].astype("int64") * (1 << 32) + part["bin"]
        return part.drop(columns=["draw", "group", "bin"])

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = partial.groupBy("group").applyInPandas(lambda part: place(part)[schema_names], schema)
    alone = pieces.where(whole).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(alone)


schema_names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
