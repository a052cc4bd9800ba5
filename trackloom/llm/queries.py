"""One query per operator over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import (
    exact_dedup,
    html_extract,
    language,
    lexical,
    licenses,
    mixing,
    near_dedup,
    packing,
    secret_scan,
    sharding,
    simhash,
    vector_codes,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.train_and_identify(_table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.similar_components(_table(spark, sf_dir, "documents"), shingle=2)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edit_fingerprints(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
             max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


# Sources reach their cap in the order of 2 * size / weight; the share of the others is one
# fraction, so integers are divided once, as in the operator.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || doc_id) AS draw,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () * 3 AS total2,
         coalesce(sum(4 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used2,
         sum(w) OVER (ORDER BY source_size / w DESC, source DESC NULLS FIRST) AS left_w
  FROM s),
f AS (
  SELECT *, min(CASE WHEN (total2 - used2) * w <= 4 * source_size * left_w
                     THEN struct_pack(r := source_size / w, n := total2 - used2, l := left_w) END)
            OVER () AS unit
  FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN unit IS NULL OR unit.n * w > 4 * source_size * unit.l THEN 2.0 * source_size
              ELSE (unit.n * w)::DOUBLE / (2 * unit.l)::DOUBLE END AS target,
         CASE WHEN unit IS NULL OR unit.n * w > 4 * source_size * unit.l THEN 2 * source_size
              ELSE (unit.n * w + unit.l) // (2 * unit.l) END AS quota
  FROM f),
p AS (
  SELECT doc_id, size, source_size, target, quota,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (quota // source_size) * size
                 + least(size, greatest(0, quota % source_size - before)) END::BIGINT AS taken
FROM p
"""



def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def _op11_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Each round as two views: nearest entries, then floored means (the operands of % are shifted to be positive)."""

    def nearest(book: str) -> str:
        return f"""
  SELECT rn, pos, arg_min(entry, (far, entry)) AS entry, min(far) AS far
  FROM (SELECT rn, p.pos, entry, sum((x - c) * (x - c))::BIGINT AS far
        FROM p JOIN {book} b ON p.pos = b.pos AND p.k = b.k GROUP BY rn, p.pos, entry)
  GROUP BY rn, pos"""

    views = [
        """v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn, vec_id, label, embedding
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        """q AS (
  SELECT rn, len(embedding) // 8 AS w, unnest(range(len(embedding))) AS i,
         unnest([floor(4096 * x::DOUBLE)::BIGINT for x in embedding]) AS x FROM v)""",
        "p AS (SELECT rn, i // w AS pos, i % w AS k, x FROM q)",
        "b0 AS (SELECT pos, rn - 1 AS entry, k, x AS c FROM p WHERE rn <= 16)",
    ]
    for r in range(rounds):
        views.append(f"n{r} AS MATERIALIZED ({nearest(f'b{r}')})")
        views.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT b.pos, b.entry, b.k,
         CASE WHEN n IS NULL THEN c ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS c
  FROM b{r} b LEFT JOIN (
    SELECT p.pos, entry, k, sum(x)::BIGINT AS total, count(*)::BIGINT AS n
    FROM p JOIN n{r} a ON p.rn = a.rn AND p.pos = a.pos GROUP BY p.pos, entry, k) s
  ON b.pos = s.pos AND b.entry = s.entry AND b.k = s.k)""")
    views.append(f"""e AS (
  SELECT rn, string_agg(printf('%02x', entry::INT), '' ORDER BY pos) AS code, sum(far)::BIGINT AS error
  FROM ({nearest(f'b{rounds}')}) GROUP BY rn)""")
    return "WITH " + ",\n".join(views) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY pos, entry, k)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN e USING (rn)
"""


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS rn, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, unnest(list_distinct(
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM words WHERE len(w) > 0),
tf AS (
  SELECT rn, term, count(*)::BIGINT AS tf FROM (SELECT rn, unnest(w) AS term FROM words)
  WHERE term IN (SELECT term FROM item_words) GROUP BY rn, term),
weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, whole GROUP BY term, n_docs),
damp AS (SELECT rn, doc_id, 50 + (50 * len(w)::BIGINT * n_docs) // n_terms AS m FROM words, whole WHERE len(w) > 0),
scored AS (
  SELECT item_id, doc_id, rn, sum(weight.w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM item_words JOIN weight USING (term) JOIN tf USING (term) JOIN damp USING (rn)
  GROUP BY item_id, doc_id, rn),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


OP13_SQL = """
SELECT page_id, octet_length(payload) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM (SELECT page_id, payload, sha256(payload) AS payload_digest,
             CASE WHEN octet_length(payload) < 100 THEN page_id
                  ELSE min(page_id) OVER (PARTITION BY payload) END AS first_id
      FROM (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages))
"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_secret_scan": (op1_secret_scan, None),
    "op2_language": (op2_language, None),
    "op3_licenses": (op3_licenses, None),
    "op4_main_text": (op4_main_text, None),
    "op5_near_dedup": (op5_near_dedup, None),
    "op6_fingerprints": (op6_fingerprints, None),
    "op7_packing": (op7_packing, None),
    "op8_exact_dedup": (op8_exact_dedup, OP8_SQL),
    "op9_sharding": (op9_sharding, None),
    "op10_mixing": (op10_mixing, OP10_SQL),
    "op11_vector_codes": (op11_vector_codes, _op11_sql()),
    "op12_search": (op12_search, OP12_SQL),
    "op13_warc": (op13_warc, OP13_SQL),
}
