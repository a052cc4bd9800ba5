"""Product codes of vectors, trained by Lloyd rounds over members that stay where they live.

Every vector is cut into equal parts, one codebook per part position. A part is a member
of the entry it was last assigned to and lives with the other members of (position, entry,
salt). In every round

1. owners add up the members that live with them; the sums of an entry's salts are merged
   into its new value (one row per task, entry and component is moved);
2. members are compared with the new codebook where they live, and only those whose
   nearest entry changed move, to the owner of that entry, in one shuffle.

Members that stay are never written again: each round writes its arrivals as a table of
their own, and a member of an earlier table still lives there if every codebook since has
kept it, which the owner works out from the codebooks (a few hundred integers). A lost
executor costs the tasks it ran.

Salts grow with the rows, so that no owner holds more than about ``MEMBERS`` parts of an
entry, however popular it is.

Cases: a vector that is null, empty, of another length than the first kept one or not
divisible into the parts, or that holds null, NaN, an infinity or a component of 32,768 or
more in absolute value (beyond the codec's integers) is dropped. Repeated rows and ids are
rows of their own. Null ids come after all others when the first entries are chosen; equal
ids are ordered by their vectors. With fewer rows than entries, the codebooks are that much
shorter. An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.sources.tables import materialize

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
MEMBERS = 65_536
LIMIT = 32_768
#: Below this size of a component, squared distances of up to 32 components are exact in doubles.
EXACT = 1 << 23

MEMBER = "position int, entry int, salt int, part binary"


def _nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each point, ties to the lower index."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = max(np.abs(points).max(), np.abs(entries).max())
    if top < EXACT and points.shape[1] <= 32:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        far = ((e * e).sum(axis=1) - 2 * (p @ e.T)) + (p * p).sum(axis=1)[:, None]
        far = far.astype(np.int64)
    else:
        far = np.stack([((points - entry) ** 2).sum(axis=1) for entry in entries], axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(points)), best]


def _whole_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, integer vectors) of the rows of a list column that the codec keeps."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    places = np.flatnonzero(lengths == width)
    values = np.asarray(column.take(pa.array(places)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, width)
    kept = (np.abs(values) < LIMIT).all(axis=1)
    return places[kept], np.floor(SCALE * values[kept]).astype(np.int64)


def _member_batch(position: np.ndarray, entry: np.ndarray, salt: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """Parts as rows; their integers are stored as 32-bit little-endian."""
    n, step = len(parts), parts.shape[1] * 4
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * step)
    data = pa.py_buffer(np.ascontiguousarray(parts, dtype="<i4").tobytes())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(position, pa.int32()),
            pa.array(entry, pa.int32()),
            pa.array(salt, pa.int32()),
            pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], data]),
        ],
        ["position", "entry", "salt", "part"],
    )


def _members(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    raw = b"".join(batch.column("part").to_pylist())
    parts = np.frombuffer(raw, dtype="<i4").reshape(-1, width).astype(np.int64)
    return (*(np.asarray(batch.column(c)) for c in ("position", "entry", "salt")), parts)


def _assigned(position: np.ndarray, parts: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts), dtype=np.int64)
    for p in np.unique(position):
        at = np.flatnonzero(position == p)
        out[at] = _nearest(parts[at], codebooks[p])[0]
    return out


def _still_here(position: np.ndarray, entry: np.ndarray, parts: np.ndarray, since: list[np.ndarray]) -> np.ndarray:
    """Places of the members that every codebook since their arrival has kept."""
    here = np.arange(len(parts))
    for codebooks in since:
        here = here[_assigned(position[here], parts[here], codebooks) == entry[here]]
    return here


def _first_arrivals(codebooks: np.ndarray, width: int, salts: int) -> Callable:
    n_parts, _, step = codebooks.shape

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            _, vectors = _whole_vectors(batch.column("vector"), width)
            salt = (seen + np.arange(len(vectors))) % salts
            seen += len(vectors)
            for p in range(n_parts):
                parts = vectors[:, p * step : (p + 1) * step]
                yield _member_batch(np.full(len(parts), p), _nearest(parts, codebooks[p])[0], salt, parts)

    return place


def _owner_sums(since: list[np.ndarray], shape: tuple[int, int, int]) -> Callable:
    n_parts, n_entries, step = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts * n_entries, step + 1), dtype=np.int64)
        for batch in batches:
            position, entry, _, parts = _members(batch, step)
            here = _still_here(position, entry, parts, since)
            owner = position[here].astype(np.int64) * n_entries + entry[here]
            order = np.argsort(owner, kind="stable")
            owners, first = np.unique(owner[order], return_index=True)
            if len(owners):
                total[owners, :step] += np.add.reduceat(parts[here][order], first, axis=0)
                total[owners, step] += np.diff(np.append(first, len(order)))
        owners = np.flatnonzero(total[:, step])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(owners // n_entries, step + 1), pa.int32()),
                pa.array(np.repeat(owners % n_entries, step + 1), pa.int32()),
                pa.array(np.tile(np.arange(step + 1), len(owners)), pa.int32()),
                pa.array(total[owners].reshape(-1), pa.int64()),
            ],
            ["position", "entry", "component", "total"],
        )

    return add


def _movers(since: list[np.ndarray], codebooks: np.ndarray) -> Callable:
    step = codebooks.shape[2]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position, entry, salt, parts = _members(batch, step)
            here = _still_here(position, entry, parts, since)
            new = _assigned(position[here], parts[here], codebooks)
            away = new != entry[here]
            here = here[away]
            yield _member_batch(position[here], new[away], salt[here], parts[here])

    return move


def _settle(arrivals: DataFrame) -> DataFrame:
    """Members shuffled to their owners and written there."""
    key = ["position", "entry", "salt"]
    return materialize(arrivals.repartition(*key).sortWithinPartitions(*key))


def _updated(tables: list[DataFrame], history: list[np.ndarray]) -> np.ndarray:
    """Each entry becomes the floor of its members' mean; entries without members stay."""
    shape = history[0].shape
    sums = reduce(
        DataFrame.union,
        [
            table.mapInArrow(_owner_sums(history[g + 1 :], shape), "position int, entry int, component int, total long")
            for g, table in enumerate(tables)
        ],
    )
    new = np.zeros((*shape[:2], shape[2] + 1), dtype=object)
    # One row for each entry and component: bounded by the size of the codebooks.
    for r in sums.groupBy("position", "entry", "component").agg(F.sum("total").alias("total")).collect():
        new[r.position, r.entry, r.component] = r.total
    out = history[-1].copy()
    for p, e in zip(*np.nonzero(new[:, :, -1]), strict=True):
        out[p, e] = [s // new[p, e, -1] for s in new[p, e, :-1]]
    return out


def _kept_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kept = f"forall(vector, x -> x is not null and not isnan(x) and abs(x) < {LIMIT})"
    return (
        df.select(df[id_col].alias("vec_id"), df[vector_col].cast("array<double>").alias("vector"))
        .where(F.col("vector").isNotNull() & (F.size("vector") > 0))
        .where(F.expr(kept))
    )


def train(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> np.ndarray | None:
    """The codebooks as integers [part position, entry, component]; None without any vector to keep."""
    kept = _kept_vectors(df, id_col, vector_col).where(F.size("vector") % parts == 0)
    order = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return None
    width = len(first[0].vector)
    kept = kept.where(F.size("vector") == width)
    seeds = kept.orderBy(*order).limit(entries).collect()
    start = np.floor(SCALE * np.array([r.vector for r in seeds])).astype(np.int64)
    history = [start.reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy()]
    salts = 1 + kept.count() // MEMBERS

    vectors = kept.select("vector")
    tables = [_settle(vectors.mapInArrow(_first_arrivals(history[0], width, salts), MEMBER))]
    for done in range(1, rounds + 1):
        history.append(_updated(tables, history))
        if done < rounds:
            moved = [t.mapInArrow(_movers(history[g + 1 : -1], history[-1]), MEMBER) for g, t in enumerate(tables)]
            tables.append(_settle(reduce(DataFrame.union, moved)))
    return history[-1]


def codebooks_hash(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in codebooks.reshape(-1)).encode()).hexdigest()


def _encoder(codebooks: np.ndarray) -> Callable:
    n_parts, _, step = codebooks.shape
    digits = np.array([f"{e:02x}" for e in range(codebooks.shape[1])], dtype="U2")

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, vectors = _whole_vectors(batch.column("vector"), n_parts * step)
            code, error = np.full(len(places), "", dtype=f"U{2 * n_parts}"), np.zeros(len(places), np.int64)
            for p in range(n_parts):
                best, far = _nearest(vectors[:, p * step : (p + 1) * step], codebooks[p])
                code, error = np.char.add(code, digits[best]), error + far
            rows = batch.take(pa.array(places))
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id"), rows.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    return encode_rows


def encode(
    df: DataFrame, codebooks: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, label, code and error of every vector the codec keeps; one pass, nothing is moved."""
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    return df.select(
        df[id_col].alias("vec_id"), df[label_col].alias("label"), df[vector_col].cast("array<double>").alias("vector")
    ).mapInArrow(_encoder(codebooks), f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: codes under codebooks trained on the table itself."""
    codebooks = train(df, id_col, vector_col, **options)
    if codebooks is None:
        none = df.select(df[id_col].alias("vec_id"), df[label_col].alias("label")).limit(0)
        coded = none.select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        digest = ""
    else:
        coded = materialize(encode(df, codebooks, id_col, vector_col, label_col))
        digest = codebooks_hash(codebooks)
    totals = coded.groupBy(F.col("label").alias("label_of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("label_of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
