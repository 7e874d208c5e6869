"""The queries of the llm operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive, boosted_rules, htmltext, licenses, media, mixing, packing, simhash, training_order, warc
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"), min_bytes=0)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(spark, table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return boosted_rules.quality_rules(documents, boosted_rules.fitted(documents, table(spark, sf_dir, "labels")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_offset")


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(spark, table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return additive.quality_scores(documents, additive.fitted(documents, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_media_columns": op3_media_columns,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_extraction": op5_html_extraction,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_training_order": op9_training_order,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_round_trip": """
        WITH h AS (
          SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (
          SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM h),
        b AS (
          SELECT page_id, payload_bytes, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5) AS BIGINT)) AS quads FROM d),
        e AS (
          SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((quads[CAST(i // 4 + 1 AS INT)] >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest
          FROM b),
        m AS (
          SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM e)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id = page_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
        FROM m""",
    "op8_mixing": r"""
        WITH sized AS (
          SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        per AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        weighed AS (
          SELECT *, CAST([1, 2, 3][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS w, 3 * source_size AS cap FROM per),
        levels AS (
          SELECT *, CAST(cap AS DOUBLE) / w AS r,
                 CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS DOUBLE) AS level
          FROM weighed WINDOW up AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        shared AS (
          SELECT level FROM levels WHERE r >= level ORDER BY r, source NULLS LAST LIMIT 1),
        goals AS (
          SELECT source, source_size, CASE WHEN r < (SELECT level FROM shared) THEN CAST(cap AS DOUBLE) ELSE w * (SELECT level FROM shared) END AS target FROM levels),
        queued AS (
          SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
                 coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
        numbered AS (
          SELECT *, row_number() OVER () AS id, CAST(floor(target) AS BIGINT) AS cut FROM queued),
        copies AS (
          SELECT id, doc_id, source, target, cut, copy, CAST(before AS BIGINT) + copy * source_size AS a, CAST(before AS BIGINT) + copy * source_size + size AS z
          FROM numbered, (VALUES (0), (1), (2)) c(copy)
          WHERE size > 0 AND before + copy * source_size < cut + (SELECT count(*) + 1 FROM goals)),
        packets AS (
          SELECT id, doc_id, source, target, copy, a, least(z, cut) AS z FROM copies WHERE a < cut
          UNION ALL SELECT id, doc_id, source, target, copy, greatest(a, cut), z FROM copies WHERE z > cut),
        laid AS (
          SELECT *, coalesce(sum(z - a) OVER (ORDER BY CAST(z AS DOUBLE) / target, doc_id NULLS FIRST, source NULLS FIRST, copy, a
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
          FROM packets),
        given AS (
          SELECT id, sum(least(z - a, (SELECT sum(source_size) FROM per) - place)) AS taken, min(place) AS first_offset
          FROM laid WHERE place < (SELECT sum(source_size) FROM per) GROUP BY id)
        SELECT n.doc_id, n.size, n.source_size, n.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken, CAST(g.first_offset AS BIGINT) AS first_offset
        FROM numbered n LEFT JOIN given g ON g.id = n.id""",
}
