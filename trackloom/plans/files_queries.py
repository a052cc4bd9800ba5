"""Sources and sinks: documents as JSON, files written from tables and read back."""

from __future__ import annotations

import struct
import uuid
import wave
from io import BytesIO

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.blocks import spread
from trackloom.plans import views as v
from trackloom.plans.registry import query
from trackloom.sources import artifacts as ar
from trackloom.sources import files as fl
from trackloom.sources import schemas as sc
from trackloom.sources.tables import shared_folder

KEY = ["track_id"]


def folder(t, name):
    return f"{shared_folder(t.spark).removeprefix('file://').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def preview_docs(t):
    """Orders as preview documents; six of seven carry one mistake each."""
    key = F.col("o_orderkey") % 7
    span = F.concat(
        F.lit('"start_sample": '), F.when(key == 5, F.lit('"x"')).otherwise(F.col("o_orderkey").cast("string")),
        F.lit(', "end_sample": '), (F.col("o_orderkey") + F.col("o_custkey") + 1).cast("string"),
        F.lit(', "id": "r'), F.col("o_orderkey").cast("string"), F.lit('"'),
        F.when(key == 4, F.lit(', "colour": 1')).otherwise(F.lit("")),
    )
    version = F.when(key == 2, "0.2").otherwise("0.1")
    body = F.concat(
        F.lit('{"schema_version": "'), version, F.lit('", "ranges": [{'), span, F.lit("}]"),
        F.when(key == 0, F.lit(', "extra": 1')).when(key == 1, F.lit(', "ranges": []'))
        .otherwise(F.lit("")), F.lit("}"),
    )
    text = F.when(key == 3, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return t.orders.select("o_orderkey", text.alias("text"))


@query(
    "read_artifacts",
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'unknown:extra' WHEN 1 THEN 'duplicate:'
              WHEN 2 THEN 'wrong_version' WHEN 3 THEN 'root_not_object'
              WHEN 4 THEN 'unknown:ranges[].colour' WHEN 5 THEN 'invalid_value' ELSE '' END AS reasons,
              CASE WHEN o_orderkey % 7 = 6 THEN o_orderkey + o_custkey + 1 END AS end_sample
       FROM orders""",
)
def read_artifacts(t):
    checked = ar.check_artifacts(preview_docs(t), "preview")
    ok = F.size("reasons") == 0
    return checked.select(
        "o_orderkey", F.array_join("reasons", ",").alias("reasons"),
        F.when(ok, F.col("artifact.ranges")[0]["end_sample"]).alias("end_sample"),
    )


def timeline_docs(t):
    """Orders as timelines of ``o_custkey + 1000`` samples; seven of eight break one rule each."""
    key, long = F.col("o_orderkey") % 8, F.col("o_custkey") + 1000
    text = lambda c: c.cast("string")
    pick = lambda k, odd, plain: F.when(key == k, odd).otherwise(plain)
    first = pick(2, text(long), pick(3, F.lit("7"), F.lit("5")))
    parts = [
        F.lit('{"schema_version": "0.1", "analysis": [], "source": {"path": "a.wav", "sha256": "'),
        F.sha2(text(F.col("o_orderkey")), 256), F.lit('", "sample_rate": '), pick(1, F.lit('"48000"'), F.lit("48000")),
        F.lit(', "duration_samples": '), text(long),
        F.lit('}, "signals": {"mix": {"values": [0.5, 1], "unit": "n", "hop_samples": '), pick(7, text(long), F.lit("10")),
        F.lit('}}, "events": [{"name": "a", "source": "b", "sample": '), first,
        F.lit('}, {"name": "a", "source": "b", "sample": '), pick(2, text(long), F.lit("6")),
        F.lit('}], "sections": [{"id": "x", "origin": "manual", "start_sample": 0, "end_sample": 500}, {"id": "'),
        pick(5, F.lit("x"), F.lit("y")), F.lit('", "origin": "automatic", "start_sample": '),
        pick(4, F.lit("499"), F.lit("500")), F.lit(', "end_sample": '), text(long), F.lit("}]}"),
        pick(6, F.lit(" []"), F.lit("")),
    ]
    return t.orders.select("o_orderkey", F.concat(*parts).alias("text"))


@query(
    "validate_documents",
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN 'invalid_value' WHEN 2 THEN 'event_outside_track'
              WHEN 3 THEN 'events_unordered' WHEN 4 THEN 'sections_overlap' WHEN 5 THEN 'duplicate_section'
              WHEN 6 THEN 'trailing_text' WHEN 7 THEN 'signal_outside_track' ELSE '' END AS reasons,
              CASE WHEN o_orderkey % 8 = 1 THEN 'source.sample_rate' END AS path
       FROM orders""",
)
def validate_documents(t):
    checked = ar.check_artifacts(timeline_docs(t), "timeline", validate=True)
    wrong = F.get(F.filter("problems", lambda p: p["code"] == "invalid_value"), F.lit(0))
    return checked.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"), wrong["path"].alias("path"))


@query(
    "field_drift",
    """SELECT 'extra' AS field, FALSE AS in_schema, count(*) AS documents FROM orders WHERE o_orderkey % 7 = 0""",
)
def field_drift(t):
    return sc.field_drift(preview_docs(t), "preview")


@query(
    "nested_drift",
    """SELECT 'extra' AS path, 'integer' AS found, NULL AS current_type, count(*) AS documents
       FROM orders WHERE o_orderkey % 7 = 0
       UNION ALL SELECT 'ranges[].colour', 'integer', NULL, count(*) FROM orders WHERE o_orderkey % 7 = 4
       UNION ALL SELECT 'ranges[].start_sample', 'string', 'bigint', count(*) FROM orders WHERE o_orderkey % 7 = 5
       UNION ALL SELECT unnest(['ranges[].label', 'ranges[].role']), NULL, 'string', 0""",
)
def nested_drift(t):
    return sc.nested_drift(preview_docs(t), "preview")


def pages(t):
    return ar.assemble_timeline(
        v.signals(t), v.events(t), v.sections(t), KEY, v.HOP, v.HOP_BLOCK
    )


@query(
    "assemble_timeline",
    f"""WITH {v.EV}, {v.SIG}, {v.SEC}, e AS (
          SELECT track_id, sample // {v.HOP * v.HOP_BLOCK} AS page, count(*) AS events,
                 min(sample) AS first_event FROM ev GROUP BY 1, 2), c AS (
          SELECT track_id, start_sample // {v.HOP * v.HOP_BLOCK} AS page, count(*) AS sections
          FROM sec GROUP BY 1, 2)
        SELECT s.track_id, s.page, s.hops, s.start_sample, s.total, coalesce(events, 0) AS events,
               first_event, coalesce(sections, 0) AS sections
        FROM (SELECT track_id, idx // {v.HOP_BLOCK} AS page, count(*) AS hops, min(sample) AS start_sample,
                     sum(value * (idx % {v.HOP_BLOCK} + 1)) AS total FROM sig GROUP BY 1, 2) s
        LEFT JOIN e ON e.track_id = s.track_id AND e.page = s.page
        LEFT JOIN c ON c.track_id = s.track_id AND c.page = s.page""",
)
def assemble_timeline(t):
    signal = F.col("signals")["activity"]
    weighted = F.aggregate(
        F.transform(signal["values"], lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return pages(t).select(
        "track_id", "page", F.size(signal["values"]).alias("hops"),
        signal["start_sample"].alias("start_sample"), weighted.alias("total"),
        F.size("events").alias("events"), F.get("events", F.lit(0))["sample"].alias("first_event"),
        F.size("sections").alias("sections"),
    )


@query("explode_signals", f"WITH {v.EV}, {v.SIG} SELECT track_id, name, idx, sample, value FROM sig")
def explode_signals(t):
    return ar.explode_signals(pages(t), KEY).select("track_id", "name", "idx", "sample", "value")


def benchmark_files(t):
    """Benchmark texts as files, every fifth with a suffix that is not a text format."""
    path = folder(t, "texts")
    suffix = F.array(*[F.lit(s) for s in ("md", "txt", "lrc", "srt", "bin")])
    rows = t.benchmark.select(
        F.concat_ws(".", F.col("item_id").cast("string"), suffix[(F.col("item_id") % 5).cast("int")])
        .alias("name"),
        F.col("text").cast("binary").alias("content"),
    )
    fl.write_rows_as_files(rows, path)
    return path


FILE_NAME = """item_id || '.' || CASE item_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'lrc'
  WHEN 3 THEN 'srt' ELSE 'bin' END"""


@query(
    "text_corpus",
    f"""SELECT {FILE_NAME} AS name, split_part({FILE_NAME}, '.', 2) AS suffix, md5(text) AS text,
               NULL AS reason FROM benchmark WHERE item_id % 5 < 4""",
)
def text_corpus(t):
    return fl.read_text_corpus(t.spark, benchmark_files(t)).select(
        F.substring_index("path", "/", -1).alias("name"), "suffix",
        F.md5(F.col("text").cast("binary")).alias("text"), "reason",
    )


@query(
    "file_inventory",
    f"SELECT {FILE_NAME} AS name, sha256(text) AS sha256, strlen(text) AS length FROM benchmark",
)
def file_inventory(t):
    return fl.file_inventory(t.spark, benchmark_files(t)).select(
        F.substring_index("path", "/", -1).alias("name"), "sha256", "length"
    )


def _wav(values) -> bytes:
    """Stereo 24-bit WAV with the values, in millionths, on the left channel."""
    out = BytesIO()
    with wave.open(out, "wb") as audio:
        audio.setnchannels(2)
        audio.setsampwidth(3)
        audio.setframerate(48_000)
        audio.writeframes(
            b"".join(struct.pack("<i", round(float(x) * 1e6))[:3] + b"\0\0\0" for x in values)
        )
    return out.getvalue()


@query(
    "pcm_blocks",
    """SELECT vec_id, b AS block_idx, 48000 AS sample_rate, 2 AS channels, 3 AS sample_width, 64 AS frames,
              count(*) AS samples,
              CAST(sum(round_even(CAST(embedding[b * 24 + k] AS DOUBLE) * 1000000, 0)) AS BIGINT) AS total
       FROM embeddings, (SELECT unnest(range(3)) AS b), (SELECT unnest(range(1, 25)) AS k)
       WHERE b * 24 + k <= 64 GROUP BY 1, 2""",
)
def pcm_blocks(t):
    """Each embedding as a WAV file, read back in blocks of 24 samples."""
    encode = F.pandas_udf(_encode, T.BinaryType())
    path = folder(t, "audio")
    # A file for each row is much work for few bytes, so the rows are dealt out first.
    fl.write_rows_as_files(
        spread(t.embeddings.select("vec_id", "embedding"), "vec_id").select(
            F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("name"),
            encode("embedding").alias("content"),
        ),
        path,
    )
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) * float(1 << 24)
    return fl.read_pcm(t.spark, path, block=24).select(
        F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("vec_id"), "block_idx",
        "sample_rate", "channels", "sample_width", "frames", F.size("samples").alias("samples"),
        F.bround(total, 0).cast("long").alias("total"),
    )


def _encode(vectors: pd.Series) -> pd.Series:
    return vectors.map(_wav)


@query(
    "write_once",
    """SELECT o_orderpriority, count(*) AS stored, CAST(sum(o_custkey) AS BIGINT) AS customers, 'written' AS first,
              'cached' AS again, 'conflict' AS other FROM orders GROUP BY 1""",
)
def write_once(t):
    """Orders written, written again and written with other rows: only the first is stored."""
    path = folder(t, "orders")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    changed = rows.withColumn("o_custkey", F.col("o_custkey") + 1)
    status = {"first": fl.write_once(rows, path)}
    status["again"] = fl.write_once(rows.sort("o_custkey"), path)
    status["other"] = fl.write_once(changed, path)
    stored = t.spark.read.parquet(path).groupBy("o_orderpriority").agg(
        F.count("*").alias("stored"), F.sum("o_custkey").alias("customers")
    )
    return stored.withColumns({step: F.lit(s) for step, s in status.items()})
