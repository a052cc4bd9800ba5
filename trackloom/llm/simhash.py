"""SimHash fingerprints and the search for all within a Hamming radius.

Terms are runs of two words; every distinct term votes with ``1 + log(count)`` on the
sign of each of 128 bits of its hash. The likeness of two fingerprints is the cosine
that their distance stands for, 0 where it is negative.

``within_radius`` uses permuted block tables: the bits are cut into blocks, and for each
choice of blocks one table keys the fingerprints by these blocks; fingerprints within the
radius agree in at least one table. Equal fingerprints are one entry, so groups of copies
never meet as pairs.

Cases: a null text is empty; texts without terms have fingerprint 0. Repeated rows and
equal texts have equal fingerprints. Null ids come last in the order of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.shingles import mix, shingle_hashes, word_hashes
from trackloom.sources.tables import materialize

BITS = 128
TERM_WORDS = 2
RADIUS = 3
RANGES_PER_PARTITION = 4
_U = np.uint64


def fingerprints(column: pa.Array) -> np.ndarray:
    """(rows, 16) bytes."""
    out = np.zeros((len(column), BITS // 8), np.uint8)
    for row, words, places in word_hashes(column):
        terms, bounds = shingle_hashes(words, places, TERM_WORDS)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if a == b:
                continue
            # Votes of one row are added in slices, so that a long text needs no large table.
            distinct, count = np.unique(terms[a:b], return_counts=True)
            weight = (1 + np.log(count)).astype(np.float32)
            votes = np.zeros(BITS, np.float64)
            for at in range(0, len(distinct), 8192):
                part, w = distinct[at : at + 8192], weight[at : at + 8192]
                both = np.column_stack([part, mix(part + _U(0x9E3779B97F4A7C15))])
                bits = np.unpackbits(both.view(np.uint8), axis=1).astype(np.float32)
                votes += 2.0 * (w @ bits) - w.sum()
            out[row + i] = np.packbits(votes > 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    distance = np.unpackbits(a ^ b, axis=1).sum(axis=1)
    return np.round(np.maximum(0.0, np.cos(np.pi * distance / BITS)), 6)


def _hex(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().hex() for r in rows], pa.string())


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each range closed by rows of the next one; a row is done when its next is known."""
    waiting: list[tuple] = []  # (range, tail, id, text): at most one row, whose next is still unknown

    def done(pairs: list[tuple]) -> pa.RecordBatch:
        ids, texts, nexts = zip(*pairs, strict=True) if pairs else ((), (), ())
        edited = []
        for text, nxt in zip(texts, nexts, strict=True):
            k = len(text) // 3
            edited.append(text[: len(text) - k] + nxt[:k])
        own, new, after = (fingerprints(pa.array(list(x), pa.large_string())) for x in (texts, edited, nexts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, kind),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                _hex(own),
                _hex(new),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, after)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            columns = [part.column(c).to_pylist() for c in ("range", "tail", "doc_id", "text")]
            rows = waiting + list(zip(*columns, strict=True))
            pairs = [(a[2], a[3], b[3]) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
            waiting = rows[-1:]
            yield done(pairs)


def edit_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edit, whose last third comes from the next document.

    The next document is the one with the next smaller id (the largest after the
    smallest). Documents are cut into id ranges; the first document of each range is
    also sent to the range before it, so a text is moved once.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(df[id_col].alias("doc_id"))
    points = [i / (parts * RANGES_PER_PARTITION) for i in range(1, parts * RANGES_PER_PARTITION)]
    got = ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, points)), 10_000)).first()[0]
    bounds = np.unique(np.array(got or [], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna().to_numpy()
        place = np.full(len(doc_id), len(bounds) + 1, dtype=np.int32)  # null ids come last
        place[known] = len(bounds) - np.searchsorted(bounds, doc_id[known].to_numpy().astype(np.int64), side="left")
        return pd.Series(place)

    # One row per range; their number follows the number of partitions.
    firsts = sorted(
        (r["range"], r["first"]) for r in ids.groupBy(range_of("doc_id").alias("range")).agg(F.max("doc_id").alias("first")).collect()
    )
    before = spark.createDataFrame(
        [(r, firsts[i - 1][0], first) for i, (r, first) in enumerate(firsts)], f"range int, before int, first {kind}"
    )
    docs = df.select(
        df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")
    ).withColumn("range", range_of("doc_id"))
    sent = docs.join(F.broadcast(before), "range").select(
        "doc_id",
        "text",
        F.explode(
            F.when(
                F.col("doc_id").eqNullSafe(F.col("first")),
                F.array(
                    F.struct(F.col("range"), F.lit(False).alias("tail")),
                    F.struct(F.col("before").alias("range"), F.lit(True).alias("tail")),
                ),
            ).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("tail"))))
        ).alias("to"),
    ).select("to.range", "to.tail", "doc_id", "text")
    return (
        sent.repartition(parts, "range")
        .sortWithinPartitions("range", "tail", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
        .mapInArrow(
            _edits,
            f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double",
        )
    )


def within_radius(prints: DataFrame, radius: int = RADIUS, spare: int = 2, bits: int = BITS) -> DataFrame:
    """(a, b, distance): all pairs of different fingerprints (hex column ``fingerprint``) within the radius.

    ``radius + spare`` blocks give one table for each choice of ``spare`` of them.
    """
    blocks = radius + spare
    entries = materialize(prints.where("fingerprint is not null").select("fingerprint").distinct())
    digits = bits // 4
    cuts = [digits * i // blocks for i in range(blocks + 1)]
    block = [F.substring("fingerprint", cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(blocks)]
    tables = [
        F.struct(F.lit(t).alias("table"), F.concat(*[block[i] for i in own]).alias("key"))
        for t, own in enumerate(combinations(range(blocks), spare))
    ]
    keyed = entries.select("fingerprint", F.explode(F.array(*tables)).alias("k")).select("k.table", "k.key", "fingerprint")
    common = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("table", "key")
    keyed = materialize(keyed.join(common, ["table", "key"], "left_semi"))
    words = range(1, digits + 1, 16)
    distance = sum(
        (
            F.bit_count(
                F.conv(F.substring("a", i, 16), 16, -10).cast("long").bitwiseXOR(F.conv(F.substring("b", i, 16), 16, -10).cast("long"))
            )
            for i in words
        ),
        F.lit(0),
    )
    return (
        keyed.withColumnRenamed("fingerprint", "a")
        .join(keyed.withColumnRenamed("fingerprint", "b"), ["table", "key"])
        .where("a < b")
        .select("a", "b", distance.cast("int").alias("distance"))
        .where(F.col("distance") <= radius)
        .distinct()
    )
