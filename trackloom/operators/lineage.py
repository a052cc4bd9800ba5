"""Fingerprints, cache keys, incremental selection, audits and stale propagation."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.blocks import salted_join
from trackloom.sources.tables import materialize


def ascii_json(text: Column) -> Column:
    """Escape everything outside ASCII as lower-case ``\\uXXXX``, as pairs above U+FFFF."""
    def escape(c: Column) -> Column:
        code = F.ascii(c)
        over = code - 0x10000
        return (
            F.when(code < 128, c)
            .when(code < 0x10000, F.format_string("\\u%04x", code))
            .otherwise(
                F.format_string(
                    "\\u%04x\\u%04x",
                    (F.lit(0xD800) + F.shiftright(over, 10)).cast("int"),
                    (F.lit(0xDC00) + over.bitwiseAND(F.lit(0x3FF))).cast("int"),
                )
            )
        )

    whole = F.array_join(F.transform(F.split(text, ""), escape), "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), whole).otherwise(text)


def canonical_json(columns: Sequence[str], ensure_ascii: bool = True) -> Column:
    """Compact JSON with sorted keys; nulls are kept."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return ascii_json(text) if ensure_ascii else text


def fingerprint(columns: Sequence[str], ensure_ascii: bool = True) -> Column:
    return F.sha2(canonical_json(columns, ensure_ascii), 256)


LANES = 4
LANE_HEX = 15


def cache_key(
    inputs: DataFrame, keys: Sequence[str], columns: Sequence[str], settings: Column
) -> DataFrame:
    """One key per track over all its input rows, in any order, and its settings.

    Row hashes are added up in four 60-bit lanes, so a track with any number of
    inputs combines map-side; the count and the sums are hashed once more.
    """
    row = fingerprint(columns)
    lanes = [
        F.sum(F.conv(F.substring("_row", 1 + i * LANE_HEX, LANE_HEX), 16, 10).cast("decimal(20,0)"))
        .alias(f"_lane{i}")
        for i in range(LANES)
    ]
    sums = inputs.withColumn("_row", row).withColumn("_settings", settings).groupBy(
        *keys, "_settings"
    ).agg(F.count("*").alias("_n"), *lanes)
    parts = [F.col("_settings"), F.col("_n").cast("string")]
    parts += [F.col(f"_lane{i}").cast("decimal(38,0)").cast("string") for i in range(LANES)]
    return sums.select(*keys, F.sha2(F.concat_ws("|", *parts), 256).alias("cache_key"))


def to_recompute(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tracks whose key has no completed output."""
    completed = done.where("status = 'completed'").select(*keys, "cache_key")
    return wanted.join(completed, [*keys, "cache_key"], "left_anti")


def audit(outputs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Completed outputs that are gone or changed since they were recorded."""
    rows = outputs.where("status = 'completed'").join(
        inventory.select("path", F.col("sha256").alias("actual")), "path", "left"
    )
    state = F.when(F.col("actual").isNull(), "missing").otherwise("tampered")
    return rows.where(~F.col("actual").eqNullSafe(F.col("sha256"))).select("path", state.alias("state"))


def conflicts(new: DataFrame, old: DataFrame) -> DataFrame:
    """Output paths that an earlier run already holds under another key."""
    held = old.select("path", F.col("cache_key").alias("old_key"))
    return new.select("path", F.col("cache_key").alias("new_key")).join(held, "path").where(
        ~F.col("new_key").eqNullSafe(F.col("old_key"))
    )


def stale(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Everything that depends on a changed artifact, with the shortest distance to one.

    ``edges``: from_id depends on to_id. One join per level; each level is written
    to the shared folder, so the plan stays short and lost executors do no harm.
    """
    level = materialize(changed.select("id").distinct().withColumn("depth", F.lit(0)))
    seen = level
    for depth in itertools.count(1):
        front = level.select(F.col("id").alias("to_id"))
        reached = salted_join(edges, front, ["to_id"]).select(F.col("from_id").alias("id"))
        level = materialize(
            # Ids compress well: a table under the broadcast limit may hold millions.
            reached.distinct().join(seen.select("id").hint("merge"), "id", "left_anti").withColumn(
                "depth", F.lit(depth)
            )
        )
        if level.isEmpty():  # also after a cycle: what was seen is not reached again
            break
        seen = seen.unionByName(level)
    return seen


def check_binding(
    requests: DataFrame, results: DataFrame, on: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Fields of a result that differ from its request; a request without result is missing."""
    theirs = results.select(
        *on, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_found")
    )
    wrong = F.array(
        F.when(F.col("_found").isNull(), F.lit("missing_result")),
        *[
            F.when(
                F.col("_found").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)
            )
            for f in fields
        ],
    )
    return requests.join(theirs, list(on), "left").select(
        *on, F.explode(F.filter(wrong, lambda c: c.isNotNull())).alias("field")
    )
