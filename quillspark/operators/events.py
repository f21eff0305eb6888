"""The log of sync events: sequence, counts, digests, delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.hashing import tree_digest
from quillspark.operators.ordering import number_rows
from quillspark.operators.reconcile import zero_filled

KINDS = ("representation", "rewrite", "handoff", "gap", "action")


def sequence_gaps(events: DataFrame, group: list[str], sequence: str) -> DataFrame:
    """Places where a group's sequence doesn't begin at 1 (before is 0 there) or go on by one."""
    w = Window.partitionBy(*group).orderBy(sequence)
    before = F.coalesce(F.lag(sequence).over(w), F.lit(0).cast("bigint"))
    return events.withColumn("before", before).where(F.col(sequence) - F.col("before") != 1).select(*group, "before", F.col(sequence).alias("after"))


def event_log(events: DataFrame, by: list[str]) -> DataFrame:
    """sequence, line (header, event, trailer), kind, n and the events' columns: a header with the number of events, events numbered from 1, and the count of each kind last.

    :param events: kind and columns to order by, which make each event unique.
    """
    numbered = number_rows(events, by, "sequence").withColumns({"line": F.lit("event"), "n": F.lit(1).cast("bigint")})
    counts = events.groupBy("kind").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    header = total.select(F.lit(0).cast("bigint").alias("sequence"), F.lit("header").alias("line"), "n")
    trailer = counts.join(F.broadcast(total.select((F.col("n") + 1).alias("sequence")))).select("sequence", F.lit("trailer").alias("line"), "kind", "n")
    return numbered.unionByName(header, allowMissingColumns=True).unionByName(trailer, allowMissingColumns=True)


def kind_counts(events: DataFrame, kinds: tuple[str, ...] = KINDS, column: str = "event_type") -> DataFrame:
    return zero_filled(events, column, kinds)


def digests(events: DataFrame, group: list[F.Column], order: F.Column, row: F.Column, span: int = 1000) -> DataFrame:
    """Digest of each group's events in order, in three levels."""
    return tree_digest(events, group, [F.floor(order / (span * span)).cast("bigint"), F.floor(order / span).cast("bigint")], F.concat(F.lpad(order.cast("string"), 20, "0"), F.lit("\0"), row))


def current_events(events: DataFrame, records: DataFrame) -> DataFrame:
    """Committed representation and rewrite events, and of the rest those of the record as it is now.

    :param events: kind, committed, source_id, record_sha256; :param records: source_id, record_sha256.
    """
    stays = F.coalesce(F.col("committed"), F.lit(False)) & F.col("kind").isin("representation", "rewrite")
    return events.where(stays).unionByName(events.where(~stays).join(records.select("source_id", "record_sha256").distinct(), ["source_id", "record_sha256"], "left_semi").select(events.columns))


def pending(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """Events whose result nobody has acknowledged; delivering them again does no harm."""
    return events.join(receipts.where("acknowledged").select("result_id").distinct(), "result_id", "left_anti")


def occurrence(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Number, from 0, of equal rows within a key."""
    return df.withColumn("occurrence", (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("bigint"))
