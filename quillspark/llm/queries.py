"""Queries of the training-data operators, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.boilerplate import page_articles, page_boilerplate, web_pages
from quillspark.llm.langid import detect, fit, wrong_labels
from quillspark.llm.mix import mix_sources
from quillspark.llm.neardup import groups, near_duplicates, similar_pairs
from quillspark.llm.scans import find_noise, noise_rows, repair_text
from quillspark.llm.tokenize import count_tokens, decode_ids, encode_texts
from quillspark.session import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document back from its ids."""
    return decode_ids(encode_texts(table(spark, d, "documents")))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = count_tokens(table(spark, d, "documents"), ["doc_id", "source"])
    return mix_sources(sized.select(F.col("doc_id").alias("id"), "source", F.col("n_tokens").alias("size")), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: each document with its number of copies."""
    return _mix(spark, d)[0].select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copies")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source of mix_targets."""
    return _mix(spark, d)[1]


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    documents, languages = table(spark, d, "documents"), table(spark, d, "languages")
    return detect(documents, fit(documents, languages), languages)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_labels(_stretches(spark, d)).select("doc_id", "first_para", "lang").distinct()


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every document with its language and confidence."""
    return _stretches(spark, d)


def _alike(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, d, "extracted_payloads"), "payload_id", "markdown", similarity=0.5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(*_alike(spark, d)).toDF("payload_a", "payload_b")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a payload: its group of near-duplicates and its links."""
    return groups(*_alike(spark, d)).withColumnRenamed("doc", "payload_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return page_boilerplate(web_pages(table(spark, d, "extracted_payloads"), table(spark, d, "rendered_captures")))


def p5_article(spark: SparkSession, d: str) -> DataFrame:
    """The article of every web page."""
    return page_articles(web_pages(table(spark, d, "extracted_payloads"), table(spark, d, "rendered_captures")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return noise_rows(find_noise(table(spark, d, "extracted_payloads")))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of every scanned payload."""
    payloads = table(spark, d, "extracted_payloads")
    return repair_text(payloads, find_noise(payloads))


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired, "p5_found": p5_found, "p5_article": p5_article, "p3_found": p3_found, "p3_groups": p3_groups, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_segments": p8_segments}

_PAIRS = """p AS (SELECT payload_id, any_value(markdown) AS t FROM extracted_payloads WHERE markdown IS NOT NULL AND payload_id IS NOT NULL GROUP BY 1), w AS (SELECT payload_id, regexp_extract_all(lower(t), '[\\pL\\p{Nd}]+') AS w FROM p),
s AS (SELECT DISTINCT payload_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5), n AS (SELECT payload_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS whole FROM s GROUP BY 1),
shared AS (SELECT a.payload_id AS a, b.payload_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.payload_id < b.payload_id GROUP BY 1, 2), pairs AS (SELECT a, b, x.whole = y.whole AS same FROM shared JOIN n x ON x.payload_id = a JOIN n y ON y.payload_id = b WHERE k::DOUBLE / (x.n + y.n - k) >= 0.5)"""
_GROUPS = f"""WITH RECURSIVE {_PAIRS}, members AS (SELECT payload_id, min(payload_id) OVER (PARTITION BY whole) AS class_id FROM n),
links AS (SELECT DISTINCT least(x.class_id, y.class_id) AS a, greatest(x.class_id, y.class_id) AS b FROM pairs JOIN members x ON x.payload_id = a JOIN members y ON y.payload_id = b WHERE NOT same), ends AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT class_id AS u, class_id AS v FROM members UNION SELECT r.u, e.v FROM reach r JOIN ends e ON e.u = r.v), tops AS (SELECT u, min(v) AS group_id FROM reach GROUP BY 1), degree AS (SELECT u, count(*) AS n FROM ends GROUP BY 1)
SELECT payload_id, group_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM members JOIN tops ON tops.u = class_id LEFT JOIN degree d ON d.u = class_id"""

ORACLE = {
    "p3_found": f"WITH {_PAIRS} SELECT a AS payload_a, b AS payload_b FROM pairs",
    "p3_groups": _GROUPS,
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
