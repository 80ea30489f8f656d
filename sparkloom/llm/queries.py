"""The registered queries of the training-data operators: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_knn, decontaminate, hilbert_shards, language_id, merkle_audit, near_dup, packing, repeats, secret_scan, token_counts
from .common import read, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as an archive, against an archive of pages that a fixed rule has damaged: some altered, some lost, some added."""
    pages = read(spark, sf_dir, "pages")
    damaged = pages.where(F.coalesce(F.pmod("page_id", F.lit(211)) != 17, F.lit(True))).withColumn("html", F.when(F.pmod("page_id", F.lit(97)) == 5, F.concat("html", F.lit("<!-- -->"))).otherwise(F.col("html")))
    added = pages.where(F.pmod("page_id", F.lit(499)) == 3).withColumn("page_id", F.col("page_id") + 10_000_000)
    ours, theirs = (table(merkle_audit.archive_records(x)) for x in (pages, damaged.unionByName(added)))
    return merkle_audit.audit(ours, theirs)


def op4_hyperminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.hilbert_shards(read(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the digest columns, text: what is left of the text; a character that a cut divides becomes U+FFFD."""
    found = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op8_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op9_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_knn.knn(read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontaminate, op3_merkle_fixity_audit, op4_hyperminhash_near_dup, op5_hilbert_shards, op6_best_fit_packing, op7_suffix_repeats, op8_transducer_token_counts, op9_block_knn, op10_secret_scan)}

ORACLE_SQL = {
    "op3_merkle_fixity_audit": """
        WITH b AS (SELECT page_id, url, html FROM pages WHERE page_id % 211 <> 17 OR page_id IS NULL),
             damaged AS (SELECT page_id, url, CASE WHEN page_id % 97 = 5 THEN html || '<!-- -->' ELSE html END AS html FROM b
                         UNION ALL SELECT page_id + 10000000, url, html FROM pages WHERE page_id % 499 = 3),
             e AS (SELECT chr(13) || chr(10) AS nl),
             archive AS (SELECT *, CAST(sum(length) OVER (PARTITION BY replica, file ORDER BY page_id) - length AS BIGINT) AS "offset" FROM
                (SELECT replica, page_id, page_id // 1024 AS file, text, strlen(text) AS length FROM
                    (SELECT replica, page_id, 'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || 'WARC-Target-URI: ' || url || nl
                        || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(html) || nl || nl || html || nl || nl AS text
                     FROM (SELECT 1 AS replica, * FROM pages UNION ALL SELECT 2, * FROM damaged), e)))
        SELECT coalesce(a.file, d.file) AS file, coalesce(a.page_id, d.page_id) AS record_id, coalesce(a."offset", d."offset") AS "offset",
               CASE WHEN d.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'extra' ELSE 'corrupt' END AS status
        FROM (SELECT * FROM archive WHERE replica = 1) a FULL JOIN (SELECT * FROM archive WHERE replica = 2) d ON a.page_id = d.page_id
        WHERE a.text IS DISTINCT FROM d.text""",
}
