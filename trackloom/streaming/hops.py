"""Streaming forms of the hop RMS and of the attack/release smoother."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hop_rms_stream(
    events: DataFrame, key: str, ts: str, value: str, frame: str, hop: str, delay: str
) -> DataFrame:
    """RMS per key in sliding windows; rows later than ``delay`` are dropped.

    The same call on a batch table gives the reference result.
    """
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    square = F.col(value) * F.col(value)
    return (
        rows.groupBy(key, F.window(ts, frame, hop).alias("_w"))
        .agg(F.sqrt(F.avg(square)).alias("rms"))
        .select(
            key, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "rms"
        )
    )


def open_windows(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """RMS of the windows that a run of :func:`hop_rms_stream` into ``folder`` has left open in its state.

    Read from the checkpoint by Spark's state reader, so the stream itself is not touched
    and goes on from there when more events come.
    """
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")
    window = F.col("key.window")
    return state.select(
        F.col(f"key.{key}").alias(key), window["start"].alias("window_start"), window["end"].alias("window_end"),
        F.sqrt(F.col("value.sum") / F.col("value.count")).alias("rms"),
    )


def hop_rms_to_end(stream: DataFrame, folder: str, key: str) -> DataFrame:
    """All windows of a bounded stream: those closed by the watermark and those still open at its end.

    ``stream`` is a :func:`hop_rms_stream`. Equal to the batch result where no row came
    later than the watermark allows.
    """
    return run_available(stream, folder).unionByName(open_windows(stream.sparkSession, folder, key))


def smooth_stream(
    events: DataFrame, key: str, order: str, value: str, delta_seconds: float,
    attack_seconds: float, release_seconds: float,
) -> DataFrame:
    """Attack/release smoother with the last output of each key as state.

    Rows of a key are ordered inside a micro-batch, whose size the source bounds.
    Rows of one order value are stepped by value; a row that is older than the last one
    seen is dropped: the state has moved on.
    """
    kind = {f.name: f.dataType.simpleString() for f in events.schema}[key]
    up = math.exp(-delta_seconds / attack_seconds) if attack_seconds > 0 else 0.0
    down = math.exp(-delta_seconds / release_seconds) if release_seconds > 0 else 0.0

    def advance(
        name: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([order, value])
        last, seen = state.get if state.exists else (None, None)
        out_order, out_value = [], []
        for at, x in zip(rows[order], rows[value]):
            if seen is not None and at < seen:
                continue
            last = x if last is None else x + (last - x) * (up if x > last else down)
            seen = at
            out_order.append(at)
            out_value.append(last)
        if seen is not None:
            state.update((float(last), int(seen)))
        yield pd.DataFrame({key: [name[0]] * len(out_order), order: out_order, "value": out_value})

    return (
        events.select(key, order, F.col(value).cast("double").alias(value))
        .groupBy(key)
        .applyInPandasWithState(
            advance,
            f"{key} {kind}, {order} bigint, value double",
            "last double, seen bigint",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Process everything that is there now into ``folder`` and read it back.

    The checkpoint beside the output lets a broken run go on where it stopped.
    """
    spark: SparkSession = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
