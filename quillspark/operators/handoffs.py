"""Work handed to agents and what comes back: identities, joins and their checks."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ("input_sha256", "extractor_id", "extractor_version", "config_sha256", "prerequisite_digest")


def same_attempt(a: str, b: str) -> Column:
    """Whether the five identity fields agree, nulls included."""
    out = F.lit(True)
    for f in IDENTITY:
        out = out & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return out


def open_handoffs(records: DataFrame, recipes: DataFrame) -> DataFrame:
    """Sources that need an agent, with the recipe of their last attempt; code is set where the recipe has changed since.

    :param records: source_id, state, last_attempt; :param recipes: extractor_id, and the other fields of the identity but input_sha256.
    """
    need = records.where("state = 'needs_agent'").select("source_id", "last_attempt", F.col("last_attempt.extractor_id").alias("extractor_id"))
    joined = need.join(recipes.select("extractor_id", F.struct(*[f for f in IDENTITY if f != "input_sha256"]).alias("recipe")), "extractor_id", "left")
    changed = F.lit(False)
    for f in IDENTITY[1:]:
        changed = changed | ~F.col(f"last_attempt.{f}").eqNullSafe(F.col(f"recipe.{f}"))
    return joined.select("source_id", "extractor_id", F.when(F.col("recipe").isNull(), "recipe_missing").when(changed, "recipe_changed").alias("code"))


def unheld(handoffs: DataFrame, versions: DataFrame) -> DataFrame:
    """Handoffs whose source content is no longer held."""
    return handoffs.join(versions.select("source_id", F.col("sha256").alias("input_sha256")).distinct(), ["source_id", "input_sha256"], "left_anti")


def extraction_problems(outputs: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Agents' outputs that answer no handoff, another attempt than asked for, or lack required kinds of anchors.

    :param outputs: handoff_id, attempt, anchors; :param handoffs: handoff_id, attempt, required_kinds.
    """
    o, h = outputs.alias("o"), handoffs.select("handoff_id", F.col("attempt").alias("asked"), "required_kinds").alias("h")
    kinds = F.transform(F.coalesce("anchors", F.array().cast("array<struct<kind:string,value:string>>")), lambda a: a["kind"])
    code = F.when(F.col("asked").isNull(), "handoff_unknown").when(~same_attempt("attempt", "asked"), "attempt_changed").when(F.size(F.array_except("required_kinds", kinds)) > 0, "anchor_kind_missing")
    return o.join(h, "handoff_id", "left").select("handoff_id", code.alias("code")).where("code is not null")


def event_problems(events: DataFrame, records: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Events of unknown sources or other states of them, and handoff events without exactly one handoff.

    :param events: sequence, kind, source_id, record_sha256, handoff_id; :param records: source_id, record_sha256; :param handoffs: handoff_id.
    """
    known = records.select("source_id", F.col("record_sha256").alias("now")).distinct()
    held = handoffs.groupBy("handoff_id").agg(F.count("*").alias("n"))
    code = F.when(F.col("now").isNull(), "source_unknown").when(~F.col("now").eqNullSafe(F.col("record_sha256")), "record_changed").when((F.col("kind") == "handoff") & (F.coalesce("n", F.lit(0)) != 1), "handoff_not_one")
    return events.join(known, "source_id", "left").join(held, "handoff_id", "left").select("sequence", code.alias("code")).where("code is not null")


def approval_conflicts(retrievals: DataFrame) -> DataFrame:
    """Approval events that stand for more than one scope, note and time."""
    return retrievals.groupBy("approval_event_id").agg(F.count_distinct(F.struct("approval_scope", "approval_note", "approval_recorded_at")).alias("n")).where("approval_event_id is not null and n > 1")


def cursor_breaks(pages: DataFrame) -> DataFrame:
    """Pages whose cursor isn't the one that the page before gave.

    :param pages: run_id, page, request_cursor, next_cursor.
    """
    w = Window.partitionBy("run_id").orderBy("page")
    return pages.withColumn("given", F.lag("next_cursor").over(w)).withColumn("first", F.row_number().over(w) == 1).where(~F.col("request_cursor").eqNullSafe(F.when(F.col("first"), F.lit(None)).otherwise(F.col("given")))).select("run_id", "page")


def encode_cursor(secret: bytes, run_id: str, page: int) -> str:
    """A signed cursor: url-safe, without padding."""
    body = json.dumps({"page": page, "run_id": run_id}, sort_keys=True, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest() + body).rstrip(b"=").decode()


def decode_cursor(secret: bytes, cursor: str) -> tuple[str, int]:
    raw = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))
    if not hmac.compare_digest(raw[:32], hmac.new(secret, raw[32:], hashlib.sha256).digest()):
        raise ValueError("the cursor isn't one of ours")
    body = json.loads(raw[32:])
    return body["run_id"], body["page"]
