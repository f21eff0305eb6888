"""Rules across the ledger's tables: every violation is a row of code, path and details.

Defined results: nulls compare as unequal to anything but null; repeated rows
of a table count once, but for duplicate_inventory_path, which is about them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.keys import norm_key
from quillspark.operators.citations import citation_integrity

TABLES = ("content_versions", "extracted_payloads", "inventory", "citations", "source_records")
# fixed values: kinds of anchors, spelling of keys and anchor values
KINDS = ("line", "page", "slide", "sheet", "section", "row", "block")
KEYS = {"source_id": r"^src_[0-9a-f]{64}$", "content_sha256": r"^[0-9a-f]{64}$", "derivation_id": r"^drv_[0-9a-f]{64}$"}
ANCHOR_VALUE = r"^[A-Za-z0-9._:/-]+$"
QUALITY = ("ok", "warning")


def _violation(code: str | Column, path: str | Column, details: str | Column) -> list[Column]:
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    return [(F.lit(code) if isinstance(code, str) else code).alias("code"), as_column(path).alias("path"), as_column(details).cast("string").alias("details")]


def _flagged(df: DataFrame, path: str, details: str, **codes: Column) -> DataFrame:
    """A row for each code whose condition holds: all conditions are tested in one pass."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in codes.items()]))
    return df.select(F.explode(found).alias("code"), F.col(path).alias("path"), F.col(details).cast("string").alias("details"))


def ledger_rules(records: DataFrame, inventory: DataFrame, versions: DataFrame, payloads: DataFrame) -> DataFrame:
    """Records against live files, contents and derivations.

    :param records: one row a source, keys normal.
    """
    own = records.select("source_id", F.col("current_raw_path").alias("path"), "byte_size", "media_type", "state", norm_key("active_content_sha256").alias("sha256"), norm_key("active_derivation_id").alias("derivation_id"), F.col("url_descriptor.url").alias("url"), F.col("url_descriptor.description").alias("description"))
    live = inventory.select("path", F.struct("byte_size", "media_type", "url", "description").alias("live")).distinct()
    # the two sides meet once by path
    both = own.join(live, "path", "full_outer")
    met = F.col("source_id").isNotNull() & F.col("live").isNotNull()
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"live.{c}"))
    drift = _flagged(
        both.withColumn("who", F.coalesce("source_id", F.lit(""))), "path", "who",
        source_missing_from_ledger=F.col("source_id").isNull(), ledgered_raw_path_missing=F.col("live").isNull(),
        url_descriptor_mismatch=met & F.col("live.url").isNotNull() & (differs("url") | differs("description")), raw_inventory_metadata_mismatch=met & F.col("live.url").isNull() & (differs("byte_size") | differs("media_type")),
    )
    sizes = versions.select(norm_key("source_id").alias("source_id"), norm_key("sha256").alias("sha256"), F.col("byte_size").alias("held_size")).groupBy("source_id", "sha256").agg(F.collect_set("held_size").alias("held_sizes"))
    derived = payloads.where("derivation_id is not null").groupBy(norm_key("derivation_id").alias("derivation_id")).agg(F.collect_set("state").alias("qualities"))
    judged = own.join(sizes, ["source_id", "sha256"], "left").join(derived, "derivation_id", "left")
    good = F.col("state").isin(*QUALITY)
    alone = _flagged(
        judged, "path", "source_id",
        ledger_record_key_mismatch=~F.col("source_id").rlike(KEYS["source_id"]), stale_extracting_state=F.col("state") == "extracting", raw_path_role_invalid=F.col("path").rlike(r"^/|(^|/)\.\.?(/|$)|\\|^_versions/"),
        active_version_metadata_mismatch=F.col("held_sizes").isNull() | ~F.coalesce(F.array_contains("held_sizes", F.col("byte_size")), F.lit(False)),
        active_representation_missing=good & F.col("qualities").isNull(), active_quality_state_mismatch=good & ~F.array_contains("qualities", F.col("state")),
    )
    twice = own.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(*_violation("duplicate_current_raw_path", "path", "n"))
    rows = inventory.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(*_violation("duplicate_inventory_path", "path", "n"))
    return drift.unionByName(alone).distinct().unionByName(twice).unionByName(rows)


def derivation_rules(payloads: DataFrame, versions: DataFrame, extractors: tuple[str, ...]) -> DataFrame:
    """Derivations against the contents they were made of, the registry and the spelling of their keys."""
    p = payloads.where("derivation_id is not null").select(norm_key("derivation_id").alias("derivation_id"), norm_key("source_id").alias("source_id"), norm_key("content_sha256").alias("sha256"), "extractor_id", "extractor_version").distinct()
    held = versions.select(norm_key("source_id").alias("source_id"), norm_key("sha256").alias("sha256"), F.lit(True).alias("held")).distinct()
    return _flagged(
        p.join(held, ["source_id", "sha256"], "left"), "derivation_id", "source_id",
        derivation_version_link_invalid=F.col("held").isNull(), derivation_identity_mismatch=~F.col("derivation_id").rlike(KEYS["derivation_id"]),
        derivation_extractor_id_invalid=~F.coalesce(F.col("extractor_id").isin(*extractors), F.lit(False)), derivation_extractor_version_invalid=~F.coalesce(F.col("extractor_version").rlike(r"\S"), F.lit(False)),
    ).distinct()


def citation_rules(citations: DataFrame, records: DataFrame, versions: DataFrame, payloads: DataFrame) -> DataFrame:
    """Spelling of citations, names given twice, stale contents, and what they name against the ledger."""
    c = citations.select("document", "citation_id", "citation_key", *[norm_key(k).alias(k) for k in KEYS], "anchor_kind", "anchor_value").distinct()
    bad = {f"citation_{k}_invalid": ~F.coalesce(F.col(k).rlike(p), F.lit(False)) for k, p in KEYS.items()}
    bad["citation_anchor_invalid"] = ~F.coalesce(F.col("anchor_kind").isin(*KINDS) & F.col("anchor_value").rlike(ANCHOR_VALUE), F.lit(False))
    active = records.select("source_id", norm_key("active_content_sha256").alias("active"))
    bad["citation_original_stale"] = F.col("active") != F.col("content_sha256")
    spelled = _flagged(c.join(active, "source_id", "left"), "document", "citation_key", **bad).distinct()
    twice = c.groupBy("document", "citation_id").agg(F.count_distinct("citation_key").alias("n")).where("n > 1").select(*_violation("citation_definition_duplicate", "document", "citation_id"))
    documents = c.select("citation_key", "document").distinct()
    named = citation_integrity(citations, records, versions, payloads).where("code <> 'citation_definition_invalid'").join(documents, "citation_key").select(*_violation(F.col("code"), "document", "citation_key"))
    return spelled.unionByName(twice).unionByName(named.distinct())


def validate(records: DataFrame, tables: dict[str, DataFrame], extractors: tuple[str, ...]) -> DataFrame:
    """code, path, details of all violations."""
    t = tables
    return (
        ledger_rules(records, t["inventory"], t["content_versions"], t["extracted_payloads"])
        .unionByName(derivation_rules(t["extracted_payloads"], t["content_versions"], extractors))
        .unionByName(citation_rules(t["citations"], records, t["content_versions"], t["extracted_payloads"]))
    )
