"""Ranked lexical search over bit-sliced Bloom signatures of documents.

Index (one pass over the texts): documents of like size form blocks of up to ``BLOCK``. A
document's signature holds a key for each of its terms and each frequency level that the
term reaches (levels are exact up to 8, then four to an octave). The signatures of a block
are stored by bit: slice ``b`` is the bitmap of the block's documents with bit ``b`` set, so
the documents that may hold a key are the conjunction of its few slices. A block also keeps
the lengths of its documents and the number of its documents that hold each term.

Search, for a bounded block of items at a time:

1. The conjunctions overestimate in how many levels a document has each term, hence its
   frequency; with the document's own length that gives an upper bound of every score as a
   weighted sum of slices. The ``k`` best bounds of each item are rescored from the texts,
   and the ``k``-th exact score is the item's threshold.
2. Every document whose bound reaches the threshold is rescored exactly; the others cannot
   be among the ``k`` best.

Scores and bounds are 64-bit integers; terms are known by a 64-bit hash of their bytes.

Cases: a null text has no terms. Items without terms, and documents with score 0, give no
row. Null ids rank after all others of an equal score; rows that share an id are ranked as
rows of their own, those with equal scores in any order. Repeated items are searched once
for each row. Empty tables give an empty result. Texts are read whole. Other columns are
never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.shingles import mix, text_buffers
from trackloom.sources.tables import materialize

TOP = 50
BLOCK = 512
KEY_BITS = 12
HASHES = 6
#: Documents times keys of the largest one: the bits of a block are 12 times as many.
BLOCK_KEYS = 1 << 21
#: Keys that a task holds before it cuts blocks.
HELD_KEYS = 1 << 22
#: Items, and different terms of items, that are searched together.
ITEMS = 256
ITEM_TERMS = 1 << 16
STRETCH = 1 << 20

_U = np.uint64
_TERM = np.zeros(256, dtype=bool)
_TERM[128:] = True
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _TERM[_first : _last + 1] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += _U(32)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(2 * STRETCH, 1 << n.bit_length())
    if size not in _tables:
        _tables.clear()
        _tables[size] = (_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size))
    return _tables[size]


def _terms(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of ``data`` in order, and their offsets by document; no term spans a place of ``places``."""
    solid = _TERM[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    borders = places[places < len(data)]
    first[borders] = solid[borders]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = _power_tables(len(data))
    total = np.cumsum((_LOWER[data] + _U(1)) * power[: len(data)], dtype=np.uint64)
    before = np.where(begin > 0, total[begin - 1], _U(0))
    return mix((total[end] - before) * inverse[begin]), np.searchsorted(begin, places)


def term_counts(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct term hashes, their counts) of every text of an Arrow column; null has none."""
    data, offsets = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + STRETCH, side="right")) - 1
        stop = min(n, max(row + 1, stop))
        lo = int(offsets[row])
        terms, places = _terms(data[lo : int(offsets[stop])], offsets[row : stop + 1] - lo)
        for a, b in zip(places[:-1], places[1:], strict=True):
            yield np.unique(terms[a:b], return_counts=True)
        row = stop


def levels_up_to(top: int) -> np.ndarray:
    """Frequencies at which a term gets a further key: 1 to 8, then four to an octave."""
    out, step = list(range(1, 9)), 2
    while out[-1] < top:
        out += [out[-1] + step * i for i in range(1, 5)]
        step *= 2
    return np.array(out, dtype=np.int64)


def _key(terms: np.ndarray, level: int) -> np.ndarray:
    return mix(terms + _U(level * 0xD6E8FEB86659FD93 % (1 << 64)))


def _bits(keys: np.ndarray, width: int) -> np.ndarray:
    """The slices of each key, [key, hash]; double hashing with an odd step."""
    a, b = keys >> _U(32), (keys & _U(0xFFFFFFFF)) | _U(1)
    return ((a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % _U(width)).astype(np.int64)


class _Block:
    """Documents of like size, to be written as one row."""

    def __init__(self, documents: list[tuple]):
        self.rows = [d[0] for d in documents]
        self.lengths = np.array([d[2].sum() for d in documents], dtype=np.int64)
        most = max(len(d[3]) for d in documents)
        self.width = max(64, most * KEY_BITS)
        bitmap = np.zeros((self.width, len(documents)), dtype=bool)
        for i, (_, _, _, keys) in enumerate(documents):
            bitmap[_bits(keys, self.width).reshape(-1), i] = True
        self.slices = np.packbits(bitmap, axis=1)
        self.terms, self.holders = np.unique(np.concatenate([d[1] for d in documents]), return_counts=True)


def _cut(documents: list[tuple]) -> Iterator[list[tuple]]:
    """Documents by size of signature, in blocks whose sizes differ by half at most."""
    documents.sort(key=lambda d: len(d[3]))
    start = 0
    for i in range(1, len(documents) + 1):
        if i < len(documents):
            keys, n = len(documents[i][3]), i - start
            if n < BLOCK and 2 * keys <= 3 * max(len(documents[start][3]), 16) and (n + 1) * keys <= BLOCK_KEYS:
                continue
        yield documents[start:i]
        start = i


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(documents: list[tuple]) -> Iterator[pa.RecordBatch]:
        for cut in _cut(documents):
            block = _Block(cut)
            lists = [
                pa.array([r.as_py() for r in block.rows], id_type),
                pa.array(block.lengths),
            ]
            one = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in lists]
            counted = [pa.array(block.terms.view(np.int64)), pa.array(block.holders.astype(np.int64))]
            two = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in counted]
            yield pa.RecordBatch.from_arrays(
                [one[0], one[1], pa.array([block.width], pa.int32()), pa.array([block.slices.tobytes()], pa.binary()), *two],
                ["doc_ids", "lengths", "width", "slices", "terms", "holders"],
            )

    held: list[tuple] = []
    n_keys, id_type = 0, None
    for batch in batches:
        ids = batch.column("doc_id")
        id_type = ids.type
        for doc_id, (terms, counts) in zip(ids, term_counts(batch.column("text")), strict=True):
            if not len(terms):
                continue
            levels = levels_up_to(int(counts.max()))
            keys = np.concatenate([_key(terms[counts >= t], int(t)) for t in levels if t <= counts.max()])
            held.append((doc_id, terms, counts, keys))
            n_keys += len(keys) + 2 * len(terms)
            if n_keys >= HELD_KEYS:
                yield from rows(held)
                held, n_keys = [], 0
    if held:
        yield from rows(held)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of all documents with a term, written: doc_ids, lengths, width, slices, terms, holders."""
    kind = df.schema[id_col].dataType.simpleString()
    return materialize(
        df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(
            _indexer,
            f"doc_ids array<{kind}>, lengths array<long>, width int, slices binary, terms array<long>, holders array<long>",
        )
    )


def _item_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, seq, terms): every item with its distinct terms as signed 64-bit hashes."""
    kind = df.schema[id_col].dataType.simpleString()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t.view(np.int64).tolist() for t, _ in term_counts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(found, pa.list_(pa.int64()))], ["item_id", "terms"]
            )

    return df.select(df[id_col].alias("item_id"), df[text_col].cast("string").alias("text")).mapInArrow(
        terms, f"item_id {kind}, terms array<long>"
    )


class _Query:
    """A block of items in the form that tasks use: distinct terms, their weights, and each item's terms."""

    def __init__(self, items: list[list[int]], holders: dict[int, int], n_documents: int, n_terms: int):
        self.terms = np.array(sorted({t for terms in items for t in terms if t in holders}), dtype=np.int64)
        ratio = [(2 * n_documents + 2) / (2 * holders[int(t)] + 1) for t in self.terms]
        self.weights = np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)
        self.hashes = self.terms.view(np.uint64)
        self.items = [np.searchsorted(self.terms, sorted(t for t in terms if t in holders)) for terms in items]
        self.n_documents, self.n_terms = n_documents, n_terms

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        # Document lengths times documents may leave 64 bits, so the quotient is built from Python integers.
        return np.array([50 + (50 * int(n) * self.n_documents) // self.n_terms for n in lengths], dtype=np.int64)


def _share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _bounds(query: _Query, lengths: np.ndarray, width: int, slices: bytes) -> np.ndarray:
    """Upper bounds of all scores, [item, document of the block]."""
    n = len(lengths)
    bitmap = np.frombuffer(slices, dtype=np.uint8).reshape(width, -1)
    reached = np.zeros((len(query.terms), n), dtype=np.uint8)
    alive, maps, level = np.arange(len(query.terms)), None, 0
    levels = levels_up_to(int(lengths.max()))
    while len(alive) and level < len(levels):
        own = np.bitwise_and.reduce(bitmap[_bits(_key(query.hashes[alive], int(levels[level])), width)], axis=1)
        maps = own if maps is None else own & maps
        some = maps.any(axis=1)
        alive, maps = alive[some], maps[some]
        reached[alive] += np.unpackbits(maps, axis=1, count=n)
        level += 1
    # A document at level i has the term less often than level i + 1 asks, and at most as often as it has terms.
    most = np.append(0, np.append(levels[1:], lengths.max() + 1) - 1)
    share = _share(np.minimum(most[: level + 1, None], lengths), query.damping(lengths))
    worth = share[reached, np.arange(n)] * query.weights[:, None]
    out = np.zeros((len(query.items), n), dtype=np.int64)
    for i, terms in enumerate(query.items):
        if len(terms):
            out[i] = worth[terms].sum(axis=0)
    return out


def _scan(query, id_type: pa.DataType, least: list[int] | None, top: int) -> Callable:
    """(item, doc_id, bound): with ``least``, all documents that reach it; without, the ``top`` best of the task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), []) for _ in query.items]
        for batch in batches:
            out: list[tuple] = []
            for ids, lengths, width, slices in zip(*(batch.column(c) for c in ("doc_ids", "lengths", "width", "slices")), strict=True):
                bounds = _bounds(query, np.asarray(lengths.values), width.as_py(), slices.as_buffer())
                values = ids.values
                if least is not None:
                    item, doc = np.nonzero(bounds >= np.array(least)[:, None])
                    out.append((item, values.take(pa.array(doc)), bounds[item, doc]))
                    continue
                for i in range(len(query.items)):
                    had, names = best[i]
                    floor = had[top - 1] if len(had) >= top else 1
                    new = np.flatnonzero(bounds[i] >= max(1, floor))
                    if len(new):
                        joined = np.concatenate([had, bounds[i, new]])
                        all_names = names + values.take(pa.array(new)).to_pylist()
                        order = np.argsort(-joined, kind="stable")[:top]
                        best[i] = (joined[order], [all_names[k] for k in order])
            for item, ids, bound in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.int32()), ids, pa.array(bound)], ["item", "doc_id", "bound"]
                )
        for i, (bound, ids) in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), i), pa.int32()), pa.array(ids, id_type), pa.array(bound)], ["item", "doc_id", "bound"]
            )

    return scan


def _rescorer(query, kind: pa.DataType) -> Callable:
    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items_of = batch.column("items").to_pylist()
            item, row, score = [], [], []
            for r, (terms, counts) in enumerate(term_counts(batch.column("text"))):
                if not len(terms):
                    continue
                place = np.minimum(np.searchsorted(terms, query.hashes), len(terms) - 1)
                tf = np.where(terms[place] == query.hashes, counts[place], 0).astype(np.int64)
                worth = query.weights * _share(tf, query.damping(np.array([counts.sum()])))
                for i in items_of[r]:
                    found = int(worth[query.items[i]].sum())
                    if found:
                        item.append(i)
                        row.append(r)
                        score.append(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(score, pa.int64())],
                ["item", "doc_id", "score"],
            )

    return rescore


def _rescored(query, docs: DataFrame, wanted: DataFrame, bounded: bool) -> DataFrame:
    """(item, doc_id, score > 0) from the texts of the wanted (item, doc_id)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # A document has a list of at most ITEMS items.
    lists = wanted.groupBy(F.col("doc_id").alias("wanted_id")).agg(F.collect_set("item").alias("items"))
    lists = lists.hint("broadcast" if bounded else "merge")
    return (
        docs.join(lists, F.col("doc_id").eqNullSafe(F.col("wanted_id")))
        .select("doc_id", "text", "items")
        .mapInArrow(_rescorer(query, kind), f"item int, doc_id {kind}, score long")
    )


def _best(rows: DataFrame, value: str, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc(value), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, terms) of all items, in blocks of bounded numbers of items and terms, an item with more being alone."""
    block: list[tuple] = []
    n_terms = 0
    for r in items.toLocalIterator():
        if block and (len(block) == ITEMS or n_terms + len(r.terms) > ITEM_TERMS):
            yield block
            block, n_terms = [], 0
        block.append((r.item_id, r.terms))
        n_terms += len(r.terms)
    if block:
        yield block


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    index: DataFrame | None = None,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item with a score above 0.

    ``index`` is a result of :func:`build_index` over the same documents, built if not given.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    item_kind = items.schema[item_col].dataType.simpleString()
    index = build_index(docs, id_col, text_col) if index is None else index
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    totals = index.select(
        F.coalesce(F.sum(F.size("doc_ids").cast("long")), F.lit(0)).alias("documents"),
        F.coalesce(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")), F.lit(0)).alias("terms"),
    ).first()
    places = index.select("doc_ids", "lengths", "width", "slices")
    found = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    if not totals.documents:
        return found
    wanted = materialize(_item_terms(items, item_col, item_text_col))
    holders = materialize(
        index.select(F.explode(F.arrays_zip("terms", "holders")).alias("t"))
        .select(F.col("t.terms").alias("term"), F.col("t.holders").alias("n"))
        .join(wanted.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
    )
    for block in _item_blocks(wanted.orderBy("item_id")):
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item int, item_id {item_kind}")
        terms = spark.createDataFrame([(t,) for t in {t for _, ts in block for t in ts}], "term long")
        of_block = {r.term: r.n for r in holders.join(terms, "term", "left_semi").collect()}
        query = _Query([ts for _, ts in block], of_block, totals.documents, totals.terms)
        schema = f"item int, doc_id {kind}, bound long"
        likely = _best(places.mapInArrow(_scan(query, id_type, None, top), schema), "bound", top)
        # At most ITEMS x top rows, so their ids may be broadcast.
        sure = _rescored(query, texts, likely.select("item", "doc_id"), True)
        known = _best(sure, "score", top).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
        least = [1] * len(block)
        for r in known.where(F.col("n") == top).collect():
            least[r.item] = r.low
        open_rows = places.mapInArrow(_scan(query, id_type, least, top), schema).select("item", "doc_id")
        ranked = _best(_rescored(query, texts, open_rows, False), "score", top)
        part = materialize(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        found = found.union(part)
    return found
