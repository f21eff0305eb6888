"""Queries over the ledger's history and references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.history import content_history
from quillspark.operators.references import citation_orphans, orphan_report
from quillspark.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return content_history(table(spark, d, "content_versions"), table(spark, d, "adoption_events"), table(spark, d, "source_records"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return citation_orphans(*[table(spark, d, t) for t in ("citations", "source_records", "content_versions", "extracted_payloads", "record_removals")])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select(F.col("ref_id").alias("citation_key"), "ref_field", "miss_kind")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_report": p4_report}


def _key(c: str) -> str:
    return f"lower(trim({c}, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)))"


_ORPHANS = f"""
WITH refs AS (
  SELECT citation_key, 'source_id' AS ref_field, {_key('source_id')} AS key, cited_at FROM citations
  UNION ALL SELECT citation_key, 'content_sha256', {_key('content_sha256')}, cited_at FROM citations
  UNION ALL SELECT citation_key, 'derivation_id', {_key('derivation_id')}, cited_at FROM citations),
parents AS (
  SELECT ref_field, key, min(since) AS since FROM (
    SELECT 'source_id' AS ref_field, {_key('source_id')} AS key, created_at::TIMESTAMPTZ AS since FROM source_records
    UNION ALL SELECT 'content_sha256', {_key('sha256')}, first_seen_at::TIMESTAMPTZ FROM content_versions
    UNION ALL SELECT 'derivation_id', {_key('derivation_id')}, created_at FROM extracted_payloads)
  WHERE key IS NOT NULL GROUP BY 1, 2),
log AS (
  SELECT CASE record_kind WHEN 'source' THEN 'source_id' WHEN 'version' THEN 'content_sha256' WHEN 'derivation' THEN 'derivation_id' END AS ref_field,
         {_key('record_key')} AS key, change_kind, recorded_at, removal_id FROM record_removals),
last_entry AS (
  SELECT citation_key, r.ref_field, arg_max(change_kind, (recorded_at, removal_id)) AS change_kind
  FROM refs r JOIN log l ON r.ref_field = l.ref_field AND r.key = l.key AND l.recorded_at <= r.cited_at GROUP BY 1, 2),
logged AS (SELECT DISTINCT ref_field, key FROM log),
orphans AS (
  SELECT DISTINCT r.citation_key, r.ref_field, r.cited_at,
         CASE WHEN e.change_kind = 'removed' THEN 'deleted' WHEN p.key IS NULL AND g.key IS NULL THEN 'missing' WHEN p.since > r.cited_at THEN 'late' END AS miss_kind
  FROM refs r LEFT JOIN parents p ON p.ref_field = r.ref_field AND p.key = r.key
  LEFT JOIN logged g ON g.ref_field = r.ref_field AND g.key = r.key
  LEFT JOIN last_entry e ON e.citation_key = r.citation_key AND e.ref_field = r.ref_field
  WHERE r.key IS NOT NULL)
"""

ORACLE = {
    "p2_found": f"""
WITH latest AS (
  SELECT arg_max(struct_pack(s := {_key('source_id')}, p := {_key('prior_sha256')}, a := {_key('adopted_sha256')}, t := epoch_us(recorded_at::TIMESTAMPTZ)), delivered_at) AS e FROM adoption_events GROUP BY event_id),
seen AS (SELECT {_key('source_id')} AS s, {_key('sha256')} AS h, min(epoch_us(first_seen_at::TIMESTAMPTZ)) AS t FROM content_versions GROUP BY 1, 2),
dated AS (SELECT s, h, t FROM seen WHERE t IS NOT NULL UNION ALL SELECT e.s, e.a, e.t FROM latest),
created AS (SELECT {_key('source_id')} AS s, min(epoch_us(created_at::TIMESTAMPTZ)) AS t FROM source_records GROUP BY 1),
facts AS (SELECT * FROM dated UNION ALL
  SELECT p.s, p.h, c.t FROM (SELECT DISTINCT e.s AS s, e.p AS h FROM latest) p JOIN created c ON c.s = p.s
  WHERE NOT EXISTS (SELECT 1 FROM dated d WHERE d.s = p.s AND d.h = p.h)),
starts AS (SELECT s, h, t FROM (SELECT *, lag(h) OVER (PARTITION BY s ORDER BY t, h) AS before FROM facts) WHERE before IS NULL OR before <> h)
SELECT s AS source_id, h AS sha256, t AS valid_from_us, coalesce(lead(t) OVER (PARTITION BY s ORDER BY t), -1) AS valid_to_us FROM starts""",
    "p4_found": _ORPHANS + "SELECT citation_key, ref_field, miss_kind FROM orphans WHERE miss_kind IS NOT NULL",
    "p4_report": _ORPHANS
    + """SELECT CASE ref_field WHEN 'source_id' THEN 'source_records' WHEN 'content_sha256' THEN 'content_versions' ELSE 'extracted_payloads' END AS ref_table,
  strftime(cited_at AT TIME ZONE 'UTC', '%Y-%m') AS month, miss_kind, count(*) AS n_references, count(DISTINCT citation_key) AS n_citations
  FROM orphans WHERE miss_kind IS NOT NULL GROUP BY ALL""",
}
