"""Rules on the quality of the ledger: each is a query of violating rows, and the report is their union.

Rows have rule_id, severity, code, path and details.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.keys import instant_us, norm_key
from quillspark.operators.reconcile import STATES

HEX = r"^[0-9a-f]{64}$"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    table: str
    check: Callable[[DataFrame], Column]  # true for a violation
    path: str
    severity: str = "error"


RULES = (
    Rule("source_id_invalid", "source_records", lambda t: ~norm_key("source_id").rlike(r"^src_[0-9a-f]{64}$"), "current_raw_path"),
    Rule("state_invalid", "source_records", lambda t: ~F.col("state").isin(*STATES), "current_raw_path"),
    Rule("created_at_invalid", "source_records", lambda t: instant_us("created_at").isNull(), "current_raw_path"),
    Rule("updated_before_created", "source_records", lambda t: instant_us("updated_at") < instant_us("created_at"), "current_raw_path"),
    Rule("raw_path_role_invalid", "source_records", lambda t: F.col("current_raw_path").rlike(r"^/|(^|/)\.\.?(/|$)|\\"), "current_raw_path"),
    Rule("active_representation_missing", "source_records", lambda t: F.col("state").isin("ok", "warning") & F.col("active_derivation_id").isNull(), "current_raw_path"),
    Rule("stale_extracting_state", "source_records", lambda t: F.col("state") == "extracting", "current_raw_path"),
    Rule("version_sha256_invalid", "content_versions", lambda t: ~norm_key("sha256").rlike(HEX), "raw_path"),
    Rule("first_seen_at_missing", "content_versions", lambda t: instant_us("first_seen_at").isNull(), "raw_path"),
    Rule("raw_size_negative", "content_versions", lambda t: F.col("byte_size") < 0, "raw_path"),
    Rule("raw_checksum_missing", "inventory", lambda t: F.col("sha256").isNull(), "path"),
    Rule("derivation_identity_missing", "extracted_payloads", lambda t: F.col("state").isin("ok", "warning") & F.col("derivation_id").isNull(), "derivation_id"),
    Rule("empty_extraction", "extracted_payloads", lambda t: F.col("state").isin("ok", "warning") & (F.coalesce(F.length("markdown"), F.lit(0)) == 0), "derivation_id"),
)


def violations(table: DataFrame, rule: Rule) -> DataFrame:
    """Distinct violating rows of one rule."""
    key = next(c for c in ("payload_id", "source_id", "path") if c in table.columns)
    return table.where(F.coalesce(rule.check(table), F.lit(False))).select(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.table).alias("code"), F.col(rule.path).alias("path"), F.col(key).cast("string").alias("details")
    ).distinct()


def quality_report(tables: dict[str, DataFrame], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return reduce(DataFrame.unionByName, [violations(tables[r.table], r) for r in rules if r.table in tables])


def status(records: DataFrame, inventory: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Roll-up: counts of sources by state, of live paths and of violations by rule."""
    states = records.groupBy("state").agg(F.count("*").alias("n")).select(F.lit("state").alias("what"), F.col("state").alias("name"), "n")
    paths = inventory.agg(F.count_distinct("path").alias("n")).select(F.lit("inventory").alias("what"), F.lit("paths").alias("name"), "n")
    rules = quality_report(tables).groupBy("rule_id").agg(F.count("*").alias("n")).select(F.lit("rule").alias("what"), F.col("rule_id").alias("name"), "n")
    return states.unionByName(paths).unionByName(rules)
