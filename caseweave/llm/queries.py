"""The registered queries of this subpackage with the SQL that must give the same rows, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair, decontamination, near_duplicates, packing, periodic_runs, quality_classifier, quality_rules, repeated_windows, sharding,
    token_blocks, token_counts, url_filter, warc,
)
from .common import table

SHARDS = [f"shard-{n:02d}" for n in range(16)]


def op1_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document."""
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_page_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as read back from the archives it was written to."""
    manifest = warc.write_warc(table(spark, folder, "pages"))
    records = warc.read_warc(manifest)
    revisit = F.col("record_type") == "revisit"
    digest = F.regexp_replace("digest", "^sha256:", "")
    number = lambda name: F.regexp_extract(name, r"(\d+|-\d+)$", 1).try_cast("bigint")
    found = F.when(revisit, digest).otherwise(F.sha2("payload", 256))
    return records.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.octet_length("payload")).cast("bigint").alias("payload_bytes"),
        F.when(found == digest, found).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).alias("payload_digest"),
        "record_type", F.when(revisit, number("refers_to")).alias("refers_to"),
    )


def op3_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2,048 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """The share of every document that occurs in benchmark items."""
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_shard_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The slot and the shard of every document."""
    return sharding.place(table(spark, folder, "documents").select("doc_id"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids as read back from the files they were written to."""
    manifest = token_blocks.write_token_files(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_blocks.read_token_files(manifest)


def op7_count_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The number of tokens of every document."""
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint and the component of every document."""
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The base measures of every document and whether it is kept."""
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The rule and the verdict of every page's url."""
    return url_filter.filter_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of every document, every tenth of which was looped before."""
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.looped(table(spark, folder, "documents"))))


def op12_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages of 35 words that occur again."""
    found = repeated_windows.repeated_windows(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_repair_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and the cheapest repair of every conversation after damage."""
    return conversation_repair.audited(table(spark, folder, "conversations"))


WARC_SQL = """
WITH pages_ AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), first AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM pages_
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM first
"""

#: The shards take turns (one row of ``turn`` per claim); ``free`` has a flag per slot.
SHARD_SQL = f"""
WITH RECURSIVE shard AS (
  SELECT n, 'shard-' || lpad(CAST(n AS VARCHAR), 2, '0') AS name FROM range({len(SHARDS)}) AS r(n)
), hashed AS (
  SELECT n, name,
    CAST(CAST('0x' || substr(md5('offset ' || name), 1, 15) AS BIGINT) % {sharding.SIZE} AS BIGINT) AS first,
    CAST(CAST('0x' || substr(md5('skip ' || name), 1, 15) AS BIGINT) % {sharding.SIZE - 1} + 1 AS BIGINT) AS skip
  FROM shard
), turn AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(range({sharding.SIZE}), lambda x: true) AS free, CAST(NULL AS BIGINT) AS slot,
    list_transform(range({len(SHARDS)}), lambda x: CAST(0 AS BIGINT)) AS tried
  UNION ALL
  SELECT t + 1, list_transform(free, lambda f, i: f AND i - 1 <> claim.slot), claim.slot, list_transform(tried, lambda n, i: CASE WHEN i - 1 = t % {len(SHARDS)} THEN claim.i + 1 ELSE n END)
  FROM turn, hashed, LATERAL (
    SELECT list_filter(list_transform(range(tried[h.n + 1], {sharding.SIZE}), lambda i: {{'i': i, 'slot': (h.first + i * h.skip) % {sharding.SIZE}}}), lambda c: free[c.slot + 1])[1] AS c
    FROM hashed h WHERE h.n = t % {len(SHARDS)}
  ) AS found(c), LATERAL (SELECT c.i AS i, c.slot AS slot) AS claim
  WHERE hashed.n = t % {len(SHARDS)} AND t < {sharding.SIZE}
), placed AS (
  SELECT slot, 'shard-' || lpad(CAST((t - 1) % {len(SHARDS)} AS VARCHAR), 2, '0') AS shard FROM turn WHERE t > 0
), keyed AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) % {sharding.SIZE} AS BIGINT) AS slot FROM documents
)
SELECT doc_id, slot, shard FROM keyed LEFT JOIN placed USING (slot)
"""

QUERIES = {
    "op1_quality_scores": (op1_quality_scores, None),
    "op2_page_archives": (op2_page_archives, WARC_SQL),
    "op3_pack_documents": (op3_pack_documents, None),
    "op4_decontaminate": (op4_decontaminate, None),
    "op5_shard_documents": (op5_shard_documents, SHARD_SQL),
    "op6_token_files": (op6_token_files, None),
    "op7_count_tokens": (op7_count_tokens, None),
    "op8_near_duplicates": (op8_near_duplicates, None),
    "op9_quality_rules": (op9_quality_rules, None),
    "op10_url_verdicts": (op10_url_verdicts, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_repeated_passages": (op12_repeated_passages, None),
    "op13_repair_conversations": (op13_repair_conversations, None),
}
