"""History of changing entity attributes: validity periods by tree reduction.

Facts say that an entity holds a payload from an instant on. Every fact is a
unit interval; neighbouring intervals with equal payload are merged to runs.
The facts are range-partitioned by (entity, instant), so that one hot entity
spreads over as many blocks as its facts fill. Each block folds its intervals
in sorted order. Only the runs at a block's edges can still touch others: at
most two a block. Those are merged pairwise by neighbouring blocks, in as many
rounds as the logarithm of the number of blocks.

Defined results: facts with null entity, payload or instant are left out;
repeated facts are one; of several payloads at one instant the one with the
greatest (rank, payload) counts, as the others would hold for no time; a
payload that comes back after another opens a new period; an empty input
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.keys import instant_us, norm_key
from quillspark.session import keep, shuffle_partitions

RUN_SCHEMA = "entity string, payload string, begin_us bigint, end_us bigint, node bigint, final boolean"
_ARROW = pa.schema([("entity", pa.string()), ("payload", pa.string()), ("begin_us", pa.int64()), ("end_us", pa.int64()), ("node", pa.int64()), ("final", pa.bool_())])


def _equal_to_last(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return np.r_[False, pc.equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)]


def _fold_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the sorted unit intervals of one block to runs.

    One run is always held back, as the next batch may prolong it. Runs of the
    block's first and last entity at its edges come out with final = false.
    """
    node = TaskContext.get().partitionId()
    held: pa.Table | None = None
    first = True

    def out(runs: pa.Table, ends: np.ndarray, open_: np.ndarray, final: np.ndarray) -> pa.RecordBatch:
        cols = [runs["entity"].combine_chunks(), runs["payload"].combine_chunks(), runs["at_us"].combine_chunks(), pa.array(ends, mask=open_), pa.array(np.full(len(ends), node)), pa.array(final)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

    def fold(part: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal held, first
        if held is not None:
            part = pa.concat_tables([held, part])
        at, same = part["at_us"].to_numpy(), _equal_to_last(part["entity"])
        # of several payloads at one instant the last one in order counts
        stays = np.r_[~(same[1:] & (at[1:] == at[:-1])), True]
        part = part.filter(pa.array(stays))
        same = _equal_to_last(part["entity"])
        starts = ~(same & _equal_to_last(part["payload"]))
        runs = part.filter(pa.array(starts))
        at, m = runs["at_us"].to_numpy(), runs.num_rows
        if m > 1:
            final = np.ones(m - 1, bool)
            final[0] = not first  # the block's first entity may have begun in an earlier block
            first = False
            yield out(runs.slice(0, m - 1), at[1:], ~same[starts][1:], final)
        held = runs.slice(m - 1, 1)

    tail: pa.Table | None = None  # rows of the last instant: the next batch may have more of them
    for batch in batches:
        part = pa.Table.from_batches([batch]).select(["entity", "payload", "at_us"])
        if tail is not None:
            part = pa.concat_tables([tail, part])
        if not part.num_rows:
            continue
        at, same = part["at_us"].to_numpy(), _equal_to_last(part["entity"])
        changes = np.flatnonzero(~(same & np.r_[False, at[1:] == at[:-1]]))
        cut = int(changes[-1])
        tail = part.slice(cut)
        if cut:
            yield from fold(part.slice(0, cut))
    if tail is not None:
        yield from fold(tail)
    if held is not None:
        yield out(held, np.zeros(1, np.int64), np.ones(1, bool), np.zeros(1, bool))


def _merge_round(runs: DataFrame) -> DataFrame:
    """Join each pair of neighbouring nodes; final rows pass through."""
    runs = runs.withColumn("node", F.expr("shiftright(node, 1)"))
    w = Window.partitionBy("entity", "node", "final").orderBy("begin_us")
    touched = ~F.col("final")
    runs = runs.withColumns(
        {
            "eaten": F.coalesce(touched & F.lag("end_us").over(w).isNull() & (F.lag("payload").over(w) == F.col("payload")), F.lit(False)),
            "next_begin": F.lead("begin_us").over(w),
            "next_payload": F.lead("payload").over(w),
            "next_end": F.lead("end_us").over(w),
        }
    )
    end = F.when(F.col("final") | F.col("end_us").isNotNull() | F.col("next_begin").isNull(), F.col("end_us")).when(F.col("next_payload") == F.col("payload"), F.col("next_end")).otherwise(F.col("next_begin"))
    runs = runs.withColumn("end_us", end).where(~F.col("eaten"))
    inner = F.row_number().over(w) > 1
    return runs.withColumn("final", F.col("final") | (inner & F.lead("begin_us").over(w).isNotNull())).select("entity", "payload", "begin_us", "end_us", "node", "final")


def validity_periods(facts: DataFrame) -> DataFrame:
    """Periods of equal payload.

    :param facts: entity string, payload string, at_us bigint, rank int (greater wins at one instant); other columns are ignored.
    :return: entity, payload, begin_us, end_us (null: still held).
    """
    facts = facts.select("entity", "payload", "at_us", "rank").where("entity is not null and payload is not null and at_us is not null")
    # an explicit number, so that small tables are cut into blocks as well
    blocks = facts.repartitionByRange(shuffle_partitions(facts.sparkSession), "entity", "at_us").sortWithinPartitions("entity", "at_us", "rank", "payload")
    runs = keep(blocks.mapInArrow(_fold_block, RUN_SCHEMA), "history")
    last = runs.agg(F.max("node")).first()[0] or 0
    edges = runs.where(~F.col("final"))
    rounds = math.ceil(math.log2(last + 1)) if last else 0
    for _ in range(rounds):
        edges = _merge_round(edges)
    cols = ["entity", "payload", "begin_us", "end_us"]
    return runs.where(F.col("final")).select(cols).unionByName(edges.select(cols))


def content_facts(versions: DataFrame, adoptions: DataFrame, records: DataFrame) -> DataFrame:
    """Facts of the ledger: which source holds which content from when.

    Of an event delivered more than once the last delivery counts. A content
    that is dated neither by its own row nor by an adoption, but named as the
    prior of one, is held since the record was created.
    """
    seen = (
        versions.select(norm_key("source_id").alias("entity"), norm_key("sha256").alias("payload"), instant_us("first_seen_at").alias("at_us"))
        .where("entity is not null and payload is not null")
        .groupBy("entity", "payload")
        .agg(F.min("at_us").alias("at_us"))
        .where("at_us is not null")
        .withColumn("rank", F.lit(1))
    )
    event = F.struct(
        norm_key("source_id").alias("entity"), norm_key("prior_sha256").alias("prior"), norm_key("adopted_sha256").alias("payload"), instant_us("recorded_at").alias("at_us")
    )
    latest = adoptions.select("event_id", "delivered_at", event.alias("e"))
    events = latest.where("event_id is not null").groupBy("event_id").agg(F.max_by("e", F.struct("delivered_at", "e")).alias("e")).select("e.*")
    events = events.unionByName(latest.where("event_id is null").select("e.*"))
    dated = seen.unionByName(events.select("entity", "payload", "at_us", F.lit(2).alias("rank")).where("at_us is not null and payload is not null"))
    priors = events.select("entity", F.col("prior").alias("payload")).where("payload is not null").distinct().join(dated.select("entity", "payload"), ["entity", "payload"], "left_anti")
    created = records.select(norm_key("source_id").alias("entity"), instant_us("created_at").alias("at_us")).groupBy("entity").agg(F.min("at_us").alias("at_us"))
    return dated.unionByName(priors.join(created, "entity").select("entity", "payload", "at_us", F.lit(0).alias("rank")))


def content_history(versions: DataFrame, adoptions: DataFrame, records: DataFrame) -> DataFrame:
    """Every source's sequence of contents: source_id, sha256, valid_from_us, valid_to_us (-1 for the last)."""
    periods = validity_periods(content_facts(versions, adoptions, records))
    return periods.select(
        F.col("entity").alias("source_id"), F.col("payload").alias("sha256"), F.col("begin_us").alias("valid_from_us"), F.coalesce("end_us", F.lit(-1).cast("bigint")).alias("valid_to_us")
    )
