"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Rows alone with their length leave after the first grouping, rows alone with their
(length, prefix hash) after the second; only the others are grouped by the hash of
their whole content. All groupings move small digest rows, never texts.

Cases: a null text equals the empty text. Null ids never win against an id; a group
without any id has a null ``keep_id`` and keeps its rows. Rows repeated with the
same id and text are all flagged ``kept``; ``exact_dedup`` then returns one of them.
An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.sources.tables import materialize

HEAD_CHARS = 64


def _length(text) -> F.Column:
    return F.octet_length(text).cast("long")


def _digests(df: DataFrame, id_col: str, text_col: str, full: bool) -> DataFrame:
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    columns = [
        df[id_col].alias("doc_id"),
        _length(text).alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, HEAD_CHARS)).alias("head_hash"),
    ]
    if full:
        columns.append(F.sha2(text, 256).alias("text_sha256"))
    return df.select(*columns)


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` occur more than once."""
    common = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    return rows.join(common, keys, "left_semi")


def _groups(rows: DataFrame) -> DataFrame:
    keys = ["n_bytes", "head_hash", "text_sha256"]
    return (
        rows.groupBy(*keys)
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    The SHA-256 of every text is part of this result, so it is computed in the one
    scan of the texts; the refinement decides which rows are grouped by it.
    """
    rows = materialize(_digests(df, id_col, text_col, True))
    survivors = _shared(_shared(rows, ["n_bytes"]), ["n_bytes", "head_hash"])
    groups = _groups(survivors)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, ["n_bytes", "head_hash", "text_sha256"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"),
        "text_sha256",
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts (the largest id), all columns.

    Whole texts are hashed only for rows that share length and prefix hash with
    another row. Of rows repeated with the same id and text one is returned.
    """
    rows = materialize(_digests(df, id_col, text_col, False))
    survivors = _shared(_shared(rows, ["n_bytes"]), ["n_bytes", "head_hash"])
    suspects = materialize(survivors.select("n_bytes", "head_hash").distinct())

    names = df.columns
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    on = ["n_bytes", "head_hash"]
    marked = df.select(
        F.struct(*[df[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"),
        _length(text).alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, HEAD_CHARS)).alias("head_hash"),
    )
    id_of, text_of = (F.col(f"row.c{names.index(c)}") for c in (id_col, text_col))
    alone = marked.join(suspects, on, "left_anti").select("row")
    # Only survivors are read in full; each task keeps one row of a group, whatever the group's size.
    kept = (
        marked.join(suspects, on, "left_semi")
        .groupBy(*on, F.sha2(F.coalesce(text_of.cast("string"), F.lit("")), 256).alias("full"))
        .agg(F.max_by("row", F.struct(id_of)).alias("row"))
        .select("row")
    )
    return alone.union(kept).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
