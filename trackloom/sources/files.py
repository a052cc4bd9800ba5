"""Files as tables: text corpora, inventories, PCM audio, and the write-once sink."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.lineage import cache_key
from trackloom.sources import pcm

TEXT_SUFFIXES = ("md", "txt", "lrc", "srt")


def _local_only(path: str) -> None:
    if "://" in path and not path.startswith(("file://", "hdfs://")):
        raise ValueError(f"remote path is not allowed: {path}")


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Text files of the known formats with suffix, text and a reason when not valid UTF-8."""
    _local_only(path)
    either = ["".join(f"[{c}{c.upper()}]" for c in s) for s in TEXT_SUFFIXES]
    pattern = "*.{" + ",".join(either) + "}"
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", "true"
    ).load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return rows.select(
        "path",
        F.lower(F.substring_index("path", ".", -1)).alias("suffix"),
        F.when(valid, F.col("content").cast("string")).alias("text"),
        F.when(~valid, "invalid_utf8").alias("reason"),
    )


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Content hash and size of every file under a folder."""
    _local_only(path)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.sha2("content", 256).alias("sha256"), "length"
    )


def read_pcm(spark: SparkSession, path: str, block: int = pcm.BLOCK, split_bytes: int = pcm.SPLIT_BYTES) -> DataFrame:
    """24-bit WAV files as mono sample blocks with the header facts (see :mod:`trackloom.sources.pcm`)."""
    _local_only(path)
    return pcm.read_pcm(spark, path, block, split_bytes)


def write_rows_as_files(rows: DataFrame, folder: str) -> None:
    """Write ``content`` of each row to ``folder/name`` through Arrow's file systems.

    ``folder`` must be one that all executors share. Each task writes its own rows under
    names of its attempt and then renames them, so a repeated task leaves whole files.
    """
    folder = folder if ":/" in folder else f"file://{folder}"
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root)

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                partial = f"{root}/.{uuid.uuid4().hex}.part"
                with system.open_output_stream(partial, compression=None) as out:
                    out.write(content)
                system.move(partial, f"{root}/{name}")
            yield pd.DataFrame({"n": [len(batch)]})

    rows.select("name", "content").mapInPandas(save, "n long").agg(F.sum("n")).collect()


def table_digest(df: DataFrame, columns: Sequence[str]) -> str:
    """Hash of all rows in any order."""
    one = cache_key(df.withColumn("_all", F.lit(1)), ["_all"], list(columns), F.lit("table"))
    row = one.first()
    return row["cache_key"] if row else "empty"


def write_once(df: DataFrame, path: str) -> str:
    """Write a table unless it exists: "written", "cached" when equal, else "conflict".

    Never overwrites. The data go to a staging folder of their own that is renamed at
    the end, so one left by a lost run blocks nothing; there must be one writer per path.
    """
    spark = df.sparkSession
    columns = sorted(df.columns)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        stored = spark.read.parquet(path)
        same = sorted(stored.columns) == columns and table_digest(
            stored, columns
        ) == table_digest(df, columns)
        return "cached" if same else "conflict"
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(staging)
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"could not move {staging} to {path}")
    return "written"
