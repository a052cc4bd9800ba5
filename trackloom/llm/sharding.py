"""Shards of nearly equal bytes by sampled splitters.

A size-weighted sample of the record keys gives quantile boundaries; records are
range-partitioned by them, every range is measured exactly, and in a range that holds
too much every big group of equal texts becomes a range of its own; what is left is
subdivided by the hash of the key. The measured ranges are dealt
to the shards, largest first to the lightest shard. The key is the hash of the text,
so equal texts stay in one range and one shard, unless their group alone is larger
than a shard; then its parts, cut by the hash of the record id, are dealt singly.

The driver sees splitters and one row per range: their number follows the parameters
(``shards`` and ``ranges_per_shard``), not the rows; so does that of the big groups.

Cases: a null text has size 1 and counts as empty for the checksum; null ids are
allowed. Repeated rows are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trackloom.sources.tables import materialize

SAMPLE_PER_RANGE = 32
SEED = 20


def _splitters(rows: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Quantile boundaries of a size-weighted sample of the keys; at most ``ranges - 1``."""
    wanted = ranges * SAMPLE_PER_RANGE
    dice = F.pmod(F.xxhash64("key", "id_hash", F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(dice < F.col("size") * (wanted / total))
    points = [i / ranges for i in range(1, ranges)]
    got = sample.agg(F.percentile_approx("key", F.array(*map(F.lit, points)), 10_000)).first()[0]
    return np.unique(np.array(got or [], dtype=np.int64))


def _deal(items: list[tuple[int, tuple]], shards: int) -> dict[tuple, int]:
    """Items (size, name) to shards: the largest first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_by_bytes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 8,
    ranges_per_shard: int = 64,
) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    spark = df.sparkSession
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = materialize(
        df.select(
            df[id_col].alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.xxhash64(df[id_col]).alias("id_hash"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 1
    ranges = shards * ranges_per_shard
    splitters = _splitters(rows, total, ranges)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, key.to_numpy(), side="right").astype("int32"))

    rows = rows.withColumn("range", range_of("key"))
    fair = total / ranges
    measure = lambda of: {r[0]: r[1] for r in of.groupBy("range").agg(F.sum("size")).collect()}
    full = [r for r, size in measure(rows).items() if size > 2 * fair]
    big = (
        rows.where(F.col("range").isin(full)).groupBy("key").agg(F.sum("size").alias("size"))
        .where(F.col("size") > 2 * fair).select("key").collect()
    )
    # Less than half as many big groups as ranges; each becomes a range behind the others.
    own = spark.createDataFrame([(k, ranges + i) for i, k in enumerate(sorted(r["key"] for r in big))], "key long, own int")
    rows = rows.join(F.broadcast(own), "key", "left").withColumn("range", F.coalesce("own", "range")).drop("own")
    sizes = measure(rows)
    parts = {r: -int(-size // fair) if size > 2 * fair else 1 for r, size in sizes.items()}
    cut = spark.createDataFrame([(r, n) for r, n in parts.items()], "range int, parts int")
    # Equal texts stay in one part, but for big groups, whose parts are only counted singly unless the group is larger than a shard.
    cut_by = F.when(F.col("range") >= ranges, F.xxhash64("id_hash")).otherwise(F.xxhash64("key"))
    rows = rows.join(F.broadcast(cut), "range").withColumn("part", F.pmod(cut_by, F.col("parts")).cast("int"))
    measured = (
        rows.groupBy("range", "part")
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    whole = {r for r, size in sizes.items() if r >= ranges and size <= total / shards}
    items = [(sizes[r], (r,)) for r in sorted(whole)]
    items += [(m["size"], (m["range"], m["part"])) for m in measured if m["range"] not in whole]
    shard_of = _deal(items, shards)
    places, next_slot = [], [0] * shards
    for m in sorted(measured, key=lambda m: (m["range"], m["part"])):
        r, p = m["range"], m["part"]
        shard = shard_of[(r,) if r in whole else (r, p)]
        places.append((r, p, shard, next_slot[shard]))
        next_slot[shard] += m["n"]
    table = spark.createDataFrame(places, "range int, part int, shard int, first_slot long")
    order = Window.partitionBy("range", "part").orderBy("key", "id_hash", "doc_id", "size")
    return rows.withColumn("place", F.row_number().over(order) - 1).join(
        F.broadcast(table), ["range", "part"]
    ).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("place")).alias("slot")
    )
