"""Integrity of citations: markers, definitions, and the records that definitions name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.keys import norm_key

# fixed values: the four identity fields of a definition
FIELDS = ("source_id", "content_sha256", "derivation_id", "anchor")


def undefined_markers(markers: DataFrame, definitions: DataFrame) -> DataFrame:
    return markers.join(definitions.select("doc", "citation_id").distinct(), ["doc", "citation_id"], "left_anti")


def unused_definitions(markers: DataFrame, definitions: DataFrame) -> DataFrame:
    return definitions.join(markers.select("doc", "citation_id").distinct(), ["doc", "citation_id"], "left_anti")


def marker_counts(markers: DataFrame) -> DataFrame:
    return markers.groupBy("doc", "citation_id").agg(F.count("*").alias("n"))


def repeated_definitions(definitions: DataFrame) -> DataFrame:
    return definitions.groupBy("doc", "citation_id").agg(F.count("*").alias("n")).where("n > 1")


def parse_definition(definitions: DataFrame) -> DataFrame:
    """The identity fields of definition bodies of the form `key: value`; ..., and whether all four are there."""
    out = definitions
    for f in FIELDS:
        out = out.withColumn(f, F.nullif(F.regexp_extract("body", rf"(?:^|[`;\s]){f}\s*[:=]\s*`?([^`;\s]+)", 1), F.lit("")))
    return out.withColumn("complete", F.array_compact(F.array(*FIELDS)).isNotNull() & (F.size(F.array_compact(F.array(*FIELDS))) == len(FIELDS)))


def citation_integrity(citations: DataFrame, records: DataFrame, versions: DataFrame, payloads: DataFrame) -> DataFrame:
    """citation_key and the code of the first thing that is wrong with it: source, version, derivation, anchor.

    The version must be of the cited source, the derivation of source and
    version, and the anchor one of the derivation's. Parents are reduced to
    distinct keys first, so that repeated rows don't multiply; hot citing keys
    meet one parent row each.
    """
    c = citations.select("citation_key", norm_key("source_id").alias("s"), norm_key("content_sha256").alias("h"), norm_key("derivation_id").alias("d"), "anchor_kind", "anchor_value").distinct()
    sources = records.select(norm_key("source_id").alias("s")).distinct().withColumn("has_source", F.lit(True))
    held = versions.select(norm_key("source_id").alias("s"), norm_key("sha256").alias("h")).distinct().withColumn("has_version", F.lit(True))
    derived = payloads.where("derivation_id is not null").select(norm_key("derivation_id").alias("d"), norm_key("source_id").alias("s"), norm_key("content_sha256").alias("h"), F.explode_outer("anchors").alias("a"))
    own = derived.select("d", "s", "h").distinct().withColumn("has_derivation", F.lit(True))
    anchors = derived.where("a is not null").select("d", F.col("a.kind").alias("anchor_kind"), F.col("a.value").alias("anchor_value")).distinct().withColumn("has_anchor", F.lit(True))
    code = (
        F.when(F.col("s").isNull() | F.col("h").isNull() | F.col("d").isNull(), "citation_definition_invalid")
        .when(F.col("has_source").isNull(), "citation_source_missing")
        .when(F.col("has_version").isNull(), "citation_version_missing")
        .when(F.col("has_derivation").isNull(), "citation_derivation_missing")
        .when(F.col("has_anchor").isNull(), "citation_anchor_missing")
    )
    joined = c.join(sources, "s", "left").join(held, ["s", "h"], "left").join(own, ["d", "s", "h"], "left").join(anchors, ["d", "anchor_kind", "anchor_value"], "left")
    return joined.select("citation_key", code.alias("code")).where("code is not null")


def conflicting_evidence(citations: DataFrame, group: list[str]) -> DataFrame:
    """Groups with at least two distinct cited identities: what an unresolved conflict needs."""
    identity = F.struct(norm_key("source_id"), norm_key("content_sha256"), norm_key("derivation_id"), "anchor_kind", "anchor_value")
    return citations.groupBy(*group).agg(F.count_distinct(identity).alias("n_identities")).where("n_identities >= 2")


def rewrite_destinations(definitions: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Definitions with the destination of the given source and content replaced; all others stay as they are.

    :param definitions: doc, line_no, body, source_id, content_sha256; :param rewrites: source_id, content_sha256, old, new.
    """
    joined = definitions.join(rewrites, ["source_id", "content_sha256"], "left")
    body = F.when(F.col("new").isNotNull(), F.replace("body", F.concat(F.lit("("), F.col("old"), F.lit(")")), F.concat(F.lit("("), F.col("new"), F.lit(")")))).otherwise(F.col("body"))
    return joined.select("doc", "line_no", "source_id", "content_sha256", body.alias("body"))
