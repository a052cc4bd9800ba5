"""Strict reading of JSON artifacts, and timelines between document and table form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.blocks import int_div
from trackloom.sources.schemas import VERSION, schema
from trackloom.sources.strict import problems
from trackloom.sources.validation import violations


def check_artifacts(documents: DataFrame, kind: str, validate: bool = False) -> DataFrame:
    """Add ``artifact`` (parsed), ``problems`` and ``reasons`` (empty when the document is accepted).

    Every value is tested against its declared JSON type, at any depth; repeated keys, numbers
    that are not finite and text after the document are found too. ``problems`` has the code,
    path and JSON type of each; ``reasons`` the codes, with the path where keys are concerned.
    With ``validate`` a document that is well formed is also tested against the rules of its kind.
    """
    shape = schema(kind)
    reason = lambda p: F.when(
        p["code"].isin("unknown", "missing", "duplicate"), F.concat(p["code"], F.lit(":"), p["path"])
    ).otherwise(p["code"])
    checked = documents.withColumn("problems", problems(F.col("text"), shape)).withColumn(
        "artifact", F.from_json("text", shape)
    )
    none = F.array().cast("array<string>")
    version = F.when(
        ~F.exists("problems", lambda p: p["code"].isin("invalid_json", "root_not_object"))
        & F.col("artifact.schema_version").isNotNull()
        & (F.col("artifact.schema_version") != VERSION),
        F.array(F.lit("wrong_version")),
    ).otherwise(none)
    rules = F.when(F.size("problems") == 0, violations("artifact", kind, shape)).otherwise(none) if validate else none
    return checked.withColumn(
        "reasons", F.array_sort(F.array_distinct(F.concat(F.transform("problems", reason), version, rules)))
    )


def read_artifacts(
    spark: SparkSession, path: str, kind: str, validate: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of all JSON files under a folder; one file is one document."""
    documents = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    checked = check_artifacts(documents, kind, validate)
    good = checked.where(F.size("reasons") == 0).select("path", "artifact.*")
    return good, checked.where(F.size("reasons") > 0).select("path", "text", "reasons")


def explode_signals(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signal map of timeline documents to one row per value.

    ``idx`` counts hops from sample 0, so the pages of a track continue one another.
    """
    start = F.coalesce("_start", F.lit(0).cast("long"))
    return (
        documents.select(*keys, F.explode("signals").alias("name", "_s"))
        .select(
            *keys, "name", F.col("_s.start_sample").alias("_start"),
            F.col("_s.hop_samples").alias("_hop"), F.posexplode("_s.values").alias("_i", "value"),
        )
        .select(
            *keys, "name", (int_div(start, F.col("_hop")) + F.col("_i")).alias("idx"),
            (start + F.col("_i") * F.col("_hop")).alias("sample"),
            "value",
        )
    )


def assemble_timeline(
    signals: DataFrame,
    events: DataFrame,
    sections: DataFrame,
    keys: Sequence[str],
    hop: int,
    page_hops: int,
) -> DataFrame:
    """Tables back to timeline documents: one page of ``page_hops`` hops per row, in order.

    A track shorter than a page is one document. Longer tracks get several pages,
    each with its own signal start, so no row grows with the length of a track.
    """
    keys = list(keys)
    page = page_hops * hop
    empty = F.lit(None).cast
    parts = signals.select(
        *keys, int_div("idx", page_hops).alias("page"),
        F.struct("name", "idx", "value").alias("_signal"),
        empty("struct<sample:bigint,name:string,source:string,confidence:double>").alias("_event"),
        empty("struct<start_sample:bigint,end_sample:bigint,id:string>").alias("_section"),
    )
    parts = parts.unionByName(
        events.select(
            *keys, int_div("sample", page).alias("page"),
            F.struct("sample", "name", "source", "confidence").alias("_event"),
        ),
        allowMissingColumns=True,
    ).unionByName(
        sections.select(
            *keys, int_div("start_sample", page).alias("page"),
            F.struct("start_sample", "end_sample", F.col("section_id").alias("id")).alias("_section"),
        ),
        allowMissingColumns=True,
    )
    pages = parts.groupBy(*keys, "page").agg(
        F.sort_array(F.collect_list("_signal")).alias("_signals"),
        F.sort_array(F.collect_list("_event")).alias("events"),
        F.sort_array(F.collect_list("_section")).alias("sections"),
    )
    names = F.array_distinct(F.transform("_signals", lambda s: s["name"]))
    one = lambda n: F.filter("_signals", lambda s: s["name"] == n)
    signal_map = F.map_from_entries(
        F.transform(
            names,
            lambda n: F.struct(
                n,
                F.struct(
                    (one(n)[0]["idx"] * hop).alias("start_sample"),
                    F.lit(hop).cast("long").alias("hop_samples"),
                    F.transform(one(n), lambda s: s["value"]).alias("values"),
                ),
            ),
        )
    )
    return pages.select(*keys, "page", signal_map.alias("signals"), "events", "sections")
