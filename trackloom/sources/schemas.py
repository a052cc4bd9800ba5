"""Registry of the artifact kinds as Spark schemas.

``NOT NULL`` marks a field that a document must carry. Free JSON values are kept
as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.sources.strict import fields_of

VERSION = "0.1"

# Field names and types of the stored documents.
FILE = "path: STRING NOT NULL, sha256: STRING NOT NULL"
RANGE = "start_sample: BIGINT NOT NULL, end_sample: BIGINT NOT NULL"
SOURCE = f"{FILE}, sample_rate: BIGINT NOT NULL, duration_samples: BIGINT NOT NULL"
PROVENANCE = "tool: STRING NOT NULL, version: STRING NOT NULL, parameters: MAP<STRING, STRING>"
AUDIO = (
    f"{SOURCE}, channels: BIGINT NOT NULL, sample_format: STRING NOT NULL, codec: STRING NOT NULL"
)
PROFILE = "width: BIGINT, height: BIGINT, fps_num: BIGINT, fps_den: BIGINT"
RATE = "fps_num: BIGINT NOT NULL, fps_den: BIGINT NOT NULL"
AVERAGE = "avg_fps_num: BIGINT NOT NULL, avg_fps_den: BIGINT NOT NULL"
SIZE = "width: BIGINT NOT NULL, height: BIGINT NOT NULL"
LAYER = (
    "id: STRING NOT NULL, kind: STRING NOT NULL, category: STRING NOT NULL, enabled: BOOLEAN, "
    "opacity: DOUBLE, asset_id: STRING, parameters: MAP<STRING, STRING>"
)
ROUTE = (
    "source: STRING NOT NULL, target_layer: STRING NOT NULL, target_parameter: STRING NOT NULL, "
    "transform: STRUCT<kind: STRING NOT NULL, parameters: MAP<STRING, STRING>> NOT NULL"
)
OVERRIDE = (
    "layer_id: STRING NOT NULL, enabled: BOOLEAN, opacity: DOUBLE, asset_id: STRING, "
    "parameters: MAP<STRING, STRING>"
)
LYRICS = "mode: STRING, path: STRING, font_asset_id: STRING"
BACKEND = (
    "name: STRING NOT NULL, version: STRING NOT NULL, commit: STRING NOT NULL, "
    "integration_patch_sha256: STRING NOT NULL"
)
STEM = (
    f"{AUDIO}, alignment: STRUCT<input_sample_rate: BIGINT NOT NULL, "
    "input_duration_samples: BIGINT NOT NULL, natural_output_samples: BIGINT NOT NULL, "
    "target_duration_samples: BIGINT NOT NULL, adjustment: STRING NOT NULL, "
    "adjustment_samples: BIGINT NOT NULL> NOT NULL"
)
CLIP = (
    f"range_index: BIGINT NOT NULL, range: STRUCT<{RANGE}> NOT NULL, file: STRUCT<{FILE}> NOT NULL, "
    f"probe: STRUCT<video_codec: STRING NOT NULL, video_pixel_format: STRING NOT NULL, {SIZE}, "
    f"{RATE}, {AVERAGE}, frame_count: BIGINT NOT NULL, stream_compatibility_sha256: STRING NOT NULL, "
    "has_audio: BOOLEAN NOT NULL, audio_codec: STRING NOT NULL, audio_sha256: STRING NOT NULL, "
    "audio_sample_rate: BIGINT NOT NULL, audio_channels: BIGINT NOT NULL> NOT NULL"
)
KINDS = {
    "source": f"original: STRUCT<{FILE}> NOT NULL, canonical: STRUCT<{AUDIO}> NOT NULL, "
    f"decoder: STRUCT<{PROVENANCE}> NOT NULL",
    "stems": f"source: STRUCT<{SOURCE}> NOT NULL, cache_key: STRING NOT NULL, "
    f"separator: STRUCT<{PROVENANCE}> NOT NULL, model: STRUCT<name: STRING NOT NULL, "
    "config_sha256: STRING NOT NULL, weights_sha256: STRING NOT NULL, source: STRING NOT NULL, "
    "license_status: STRING NOT NULL, redistributable: BOOLEAN NOT NULL> NOT NULL, "
    f"stems: MAP<STRING, STRUCT<{STEM}>> NOT NULL",
    "analysis": "source_sha256: STRING NOT NULL, mode: STRING NOT NULL, cache_key: STRING NOT NULL, "
    "environment: MAP<STRING, STRING> NOT NULL, timings_seconds: MAP<STRING, DOUBLE> NOT NULL, "
    f"outputs: MAP<STRING, STRUCT<{FILE}>> NOT NULL",
    "timeline": f"source: STRUCT<{SOURCE}> NOT NULL, analysis: ARRAY<STRUCT<{PROVENANCE}>> NOT NULL, "
    "signals: MAP<STRING, STRUCT<start_sample: BIGINT, hop_samples: BIGINT NOT NULL, "
    "values: ARRAY<DOUBLE> NOT NULL, unit: STRING NOT NULL>>, "
    "events: ARRAY<STRUCT<name: STRING NOT NULL, source: STRING NOT NULL, sample: BIGINT NOT NULL, "
    "confidence: DOUBLE>>, "
    f"sections: ARRAY<STRUCT<{RANGE}, id: STRING NOT NULL, label: STRING, origin: STRING NOT NULL, "
    "confidence: DOUBLE>>",
    "structure": f"source: STRUCT<{SOURCE}> NOT NULL, timeline: STRUCT<{FILE}> NOT NULL, "
    f"cache_key: STRING NOT NULL, analyzer: STRUCT<{PROVENANCE}> NOT NULL, "
    "beat_samples: ARRAY<BIGINT>, boundaries: ARRAY<STRUCT<id: STRING NOT NULL, "
    "sample: BIGINT NOT NULL, confidence: DOUBLE NOT NULL, sources: ARRAY<STRING> NOT NULL>>, "
    "repeated_groups: ARRAY<STRUCT<id: STRING NOT NULL, confidence: DOUBLE NOT NULL, "
    f"spans: ARRAY<STRUCT<{RANGE}, id: STRING NOT NULL, group_id: STRING NOT NULL, "
    "confidence: DOUBLE NOT NULL, start_anchor_index: BIGINT NOT NULL, "
    "end_anchor_index: BIGINT NOT NULL>> NOT NULL>>",
    "structure-selection": f"reviewed: BOOLEAN NOT NULL, structure: STRUCT<{FILE}> NOT NULL, "
    f"timeline: STRUCT<{FILE}> NOT NULL, existing_sections_policy: STRING NOT NULL, "
    f"sections: ARRAY<STRUCT<{RANGE}, id: STRING NOT NULL, label: STRING, "
    "start_boundary_id: STRING, end_boundary_id: STRING>> NOT NULL",
    "plan": "timeline_path: STRING NOT NULL, assets_path: STRING NOT NULL, mode: STRING NOT NULL, "
    f"seed: BIGINT NOT NULL, output: STRUCT<{PROFILE}>, layers: ARRAY<STRUCT<{LAYER}>> NOT NULL, "
    f"routes: ARRAY<STRUCT<{ROUTE}>>, sections: ARRAY<STRUCT<section_id: STRING NOT NULL, "
    f"layers: ARRAY<STRUCT<{OVERRIDE}>> NOT NULL, transition_samples: BIGINT>>, "
    f"lyrics: STRUCT<{LYRICS}>",
    "resolved-plan": f"source_plan: STRUCT<{FILE}> NOT NULL, timeline_path: STRING NOT NULL, "
    "timeline_sha256: STRING NOT NULL, assets_path: STRING NOT NULL, assets_sha256: STRING NOT NULL, "
    "checked_assets_path: STRING NOT NULL, checked_assets_sha256: STRING NOT NULL, "
    f"mode: STRING NOT NULL, seed: BIGINT NOT NULL, output: STRUCT<{PROFILE}>, "
    f"duration_samples: BIGINT NOT NULL, routes: ARRAY<STRUCT<{ROUTE}>>, "
    f"spans: ARRAY<STRUCT<{RANGE}, section_id: STRING, section_label: STRING, "
    f"section_origin: STRING, transition_samples: BIGINT, layers: ARRAY<STRUCT<{LAYER}>> NOT NULL>> "
    f"NOT NULL, lyrics: STRUCT<{LYRICS}>, lyrics_sha256: STRING",
    "assets": f"assets: ARRAY<STRUCT<id: STRING NOT NULL, {FILE}, type: STRING NOT NULL, "
    "origin: STRING NOT NULL, license: STRING, source_note: STRING>> NOT NULL",
    "checked-assets": f"source_manifest: STRUCT<{FILE}> NOT NULL, cache_key: STRING NOT NULL, "
    f"assets: ARRAY<STRUCT<{FILE}, id: STRING NOT NULL, type: STRING NOT NULL, width: BIGINT, "
    "height: BIGINT, frame_count: BIGINT, fps_num: BIGINT, fps_den: BIGINT, "
    "duration_seconds: DOUBLE, has_audio: BOOLEAN, font_families: ARRAY<STRING>>> NOT NULL",
    "lyrics": "language: STRING NOT NULL, text_source: STRING NOT NULL, "
    "text_source_sha256: STRING NOT NULL, audio_sha256: STRING NOT NULL, origin: STRING NOT NULL, "
    f"provenance: STRUCT<{PROVENANCE}> NOT NULL, "
    f"cues: ARRAY<STRUCT<{RANGE}, text: STRING NOT NULL>> NOT NULL",
    "alignment": f"cache_key: STRING NOT NULL, language: STRING NOT NULL, "
    f"text_source: STRUCT<{FILE}> NOT NULL, audio: STRUCT<{FILE}> NOT NULL, "
    "audio_kind: STRING NOT NULL, audio_offset_samples: BIGINT, "
    f"runtime: STRUCT<{PROVENANCE}> NOT NULL, elapsed_seconds: DOUBLE NOT NULL, "
    f"output: STRUCT<{FILE}> NOT NULL, lines: ARRAY<STRUCT<source_line: BIGINT NOT NULL, "
    "text: STRING NOT NULL, normalized_characters: BIGINT NOT NULL, status: STRING NOT NULL, "
    "coverage: DOUBLE NOT NULL, start_sample: BIGINT, end_sample: BIGINT, reason: STRING>> NOT NULL, "
    "evaluation: STRUCT<reference_points: BIGINT NOT NULL, matched_reference_points: BIGINT NOT NULL, "
    "unmatched_reference_points: BIGINT NOT NULL, median_absolute_error_samples: BIGINT NOT NULL, "
    "p90_absolute_error_samples: BIGINT NOT NULL, median_limit_samples: BIGINT, "
    "p90_limit_samples: BIGINT, passed: BOOLEAN NOT NULL>",
    "preview": f"ranges: ARRAY<STRUCT<{RANGE}, id: STRING NOT NULL, role: STRING, label: STRING>> "
    "NOT NULL",
    "render": "cache_key: STRING NOT NULL, status: STRING NOT NULL, source_sha256: STRING NOT NULL, "
    f"canonical_audio_sha256: STRING, profile: STRUCT<{PROFILE}>, "
    "inputs: MAP<STRING, STRING> NOT NULL, seed: BIGINT NOT NULL, "
    f"environment: MAP<STRING, STRING> NOT NULL, ranges: ARRAY<STRUCT<{RANGE}>> NOT NULL, "
    f"outputs: ARRAY<STRUCT<{FILE}>>, error: STRING",
    "provider-request": f"source: STRUCT<{SOURCE}> NOT NULL, canonical_audio: STRUCT<{FILE}> NOT NULL, "
    f"profile: STRUCT<{PROFILE}> NOT NULL, range: STRUCT<{RANGE}> NOT NULL, "
    f"backend: STRUCT<{BACKEND}> NOT NULL, project: STRUCT<{FILE}> NOT NULL, "
    f"plugins: ARRAY<STRUCT<{FILE}>>, assets: ARRAY<STRUCT<{FILE}>>, "
    "parameters: MAP<STRING, STRING>, parameters_sha256: STRING NOT NULL",
    "provider-manifest": f"status: STRING NOT NULL, request: STRUCT<{FILE}> NOT NULL, "
    f"source_sha256: STRING NOT NULL, profile: STRUCT<{PROFILE}> NOT NULL, "
    f"range: STRUCT<{RANGE}> NOT NULL, backend: STRUCT<{BACKEND}> NOT NULL, "
    "project_sha256: STRING NOT NULL, plugin_sha256: ARRAY<STRING> NOT NULL, "
    "asset_sha256: ARRAY<STRING> NOT NULL, parameters_sha256: STRING NOT NULL, "
    f"environment: MAP<STRING, STRING> NOT NULL, video: STRUCT<{FILE}>, "
    f"probe: STRUCT<video_codec: STRING NOT NULL, pixel_format: STRING NOT NULL, {SIZE}, {RATE}, "
    f"{AVERAGE}, frame_count: BIGINT NOT NULL, has_audio: BOOLEAN NOT NULL>, "
    "error: STRUCT<stage: STRING NOT NULL, code: STRING NOT NULL, message: STRING NOT NULL>",
    "comparison-request": "variants: ARRAY<STRUCT<id: STRING NOT NULL, label: STRING NOT NULL, "
    "preview_manifest_path: STRING NOT NULL>> NOT NULL",
    "comparison": f"cache_key: STRING NOT NULL, request: STRUCT<{FILE}> NOT NULL, "
    f"source_sha256: STRING NOT NULL, ranges: ARRAY<STRUCT<{RANGE}>> NOT NULL, "
    f"profile: STRUCT<video_codec: STRING NOT NULL, video_pixel_format: STRING NOT NULL, {SIZE}, "
    f"{RATE}, stream_compatibility_sha256: STRING NOT NULL, has_audio: BOOLEAN NOT NULL, "
    "range_count: BIGINT NOT NULL> NOT NULL, variants: ARRAY<STRUCT<id: STRING NOT NULL, "
    f"label: STRING NOT NULL, preview_manifest: STRUCT<{FILE}> NOT NULL, "
    "preview_cache_key: STRING NOT NULL, inputs: MAP<STRING, STRING> NOT NULL, "
    f"environment: MAP<STRING, STRING> NOT NULL, seed: BIGINT NOT NULL, "
    f"clips: ARRAY<STRUCT<{CLIP}>> NOT NULL>> NOT NULL, tools: MAP<STRING, STRING> NOT NULL, "
    f"artifacts: STRUCT<review_reel: STRUCT<{FILE}> NOT NULL, contact_sheet: STRUCT<{FILE}> NOT NULL> "
    "NOT NULL",
}


def schema(kind: str) -> T.StructType:
    """StructType of an artifact kind (needs a running session to parse)."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}; known: {sorted(KINDS)}")
    return T.StructType.fromDDL(f"schema_version STRING NOT NULL, {KINDS[kind]}")


def flat_fields(data_type: T.DataType, path: str = "") -> list[tuple[str, str]]:
    """(path, type) of every leaf; ``[]`` stands for elements, ``{}`` for map values."""
    if isinstance(data_type, T.StructType):
        return [
            leaf
            for f in data_type.fields
            for leaf in flat_fields(f.dataType, f"{path}.{f.name}" if path else f.name)
        ]
    if isinstance(data_type, T.ArrayType):
        return flat_fields(data_type.elementType, f"{path}[]")
    if isinstance(data_type, T.MapType):
        return flat_fields(data_type.valueType, f"{path}{{}}")
    return [(path, data_type.simpleString())]


def schema_drift(spark: SparkSession, stored: T.StructType, kind: str) -> DataFrame:
    """Fields that a stored table lacks, has in addition or has with another type."""
    ddl = "path string, {} string"
    have = spark.createDataFrame(flat_fields(stored), ddl.format("stored_type"))
    want = spark.createDataFrame(flat_fields(schema(kind)), ddl.format("current_type"))
    return have.join(want, "path", "full").where("not (stored_type <=> current_type)")


def field_drift(documents: DataFrame, kind: str) -> DataFrame:
    """Top-level fields seen in stored JSON text against the current schema, with counts."""
    seen = documents.select(F.explode(F.json_object_keys("text")).alias("field")).groupBy(
        "field"
    ).agg(F.count("*").alias("documents"))
    known = F.array(*[F.lit(n) for n in schema(kind).names])
    current = documents.sparkSession.createDataFrame(
        [(n,) for n in schema(kind).names], "field string"
    )
    return (
        seen.join(current, "field", "full")
        .withColumn("in_schema", F.array_contains(known, F.col("field")))
        .withColumn("documents", F.coalesce("documents", F.lit(0).cast("long")))
        .where("not in_schema or documents = 0")
    )


# JSON types that a stored value of each declared type may have.
JSON_TYPES = {"string": ("string",), "bigint": ("integer",), "double": ("integer", "number"), "boolean": ("boolean",)}


def nested_drift(documents: DataFrame, kind: str) -> DataFrame:
    """path, found, current_type, documents: leaves of stored JSON text, at any depth, that the schema does not have so.

    Every document gives its distinct (path, JSON type) pairs; these are counted with a
    map-side combine, so what is moved grows with the different paths and not with the
    documents. A null fits every type; values of free maps are one leaf. Paths of the schema
    that no document has come with ``found`` null and 0 documents.
    """
    shape = schema(kind)
    leaves = flat_fields(shape)
    free = {p for p, t in leaves if p.endswith("{}") and t == "string"}
    want = documents.sparkSession.createDataFrame(
        [(p, t, list(("free",) if p in free else JSON_TYPES[t])) for p, t in leaves],
        "path string, current_type string, allowed array<string>",
    )
    seen = (
        documents.select(F.explode(fields_of(F.col("text"), shape)).alias("f"))
        .groupBy("f.path", "f.found")
        .agg(F.count("*").alias("documents"))
    )
    return (
        seen.join(want, "path", "full")
        .where("allowed is null or found is null or (found <> 'null' and not array_contains(allowed, found))")
        .select("path", "found", "current_type", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))
    )
