"""References to records that do not exist.

Keys are range-partitioned by a 64-bit hash, so that ranges are even whatever
the keys look like. The known keys of a range are kept as one sorted array; the
references of the range are probed against it in vectorised batches by binary
search and only the misses come out. The number of ranges follows from the
number of rows that name known keys, so that an array has about RANGE_KEYS keys
at any size. A range with more references than ``batch_rows`` (one key may hold
a third of all) is split by salting; the range's array goes to each of its
parts. A key is identified by 128 hash bits. The changes of state of one key are
kept together: they are as many as the key was removed and restored.

Defined results: null references are not looked up; an empty reference is a key
like any other; null instants of a reference are before nothing and after
nothing, so that it can only be missing; repeated rows give one result; with no
parents and an empty removal log every reference is missing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.keys import fingerprint, instant_us, micros, norm_key
from quillspark.session import keep, shuffle_partitions

RANGE_KEYS = 1 << 16  # rows that name a known key, a range on the average
MAX_RANGES = 1 << 20
KINDS = ("deleted", "missing", "late")
_OUT = pa.schema([("ref_id", pa.int64()), ("ref_field", pa.string()), ("at_us", pa.int64()), ("miss", pa.int8())])


def _hashes() -> list:
    return [fingerprint(F.col("ref_field"), F.col("key"), seed=1).alias("h1"), fingerprint(F.col("ref_field"), F.col("key"), seed=2).alias("h2")]


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    """Misses of one batch of references against its range's sorted array of known keys."""
    if not refs.num_rows:
        return _OUT.empty_table()
    h1, h2 = refs["h1"].to_numpy(), refs["h2"].to_numpy()
    at = refs["at_us"].to_numpy(zero_copy_only=False).astype(np.float64) if refs["at_us"].null_count else refs["at_us"].to_numpy()
    n = len(h1)
    found, since, gone = np.zeros(n, bool), np.full(n, np.iinfo(np.int64).max), np.zeros(n, bool)
    in_table = np.zeros(n, bool)
    if parents.num_rows:
        known = parents["known"].combine_chunks().flatten()
        k1, k2 = known.field("h1").to_numpy(), known.field("h2").to_numpy()
        k_since = known.field("since_us").fill_null(np.iinfo(np.int64).max).to_numpy()
        k_table = known.field("in_table").to_numpy(zero_copy_only=False)
        logs = known.field("log")
        offsets, entries = logs.offsets.to_numpy(), logs.values
        log_at, log_removed = entries.field("at_us").to_numpy(zero_copy_only=False), entries.field("removed").to_numpy(zero_copy_only=False)
        place, step = np.searchsorted(k1, h1, "left"), 0
        while True:  # keys whose first hashes are equal are neighbours
            here = place + step
            inside = here < len(k1)
            here = np.minimum(here, len(k1) - 1)
            alike = inside & (k1[here] == h1)
            hit = alike & (k2[here] == h2)
            rows = np.flatnonzero(hit)
            found[rows], since[rows], in_table[rows] = True, k_since[here[rows]], k_table[here[rows]]
            logged = rows[offsets[here[rows] + 1] > offsets[here[rows]]]
            for key in np.unique(here[logged]):
                own = logged[here[logged] == key]
                a, b = offsets[key], offsets[key + 1]
                last = np.searchsorted(log_at[a:b], at[own], "right") - 1
                gone[own] = (last >= 0) & log_removed[a:b][np.maximum(last, 0)] & ~np.isnan(at[own])
            if not alike.any():
                break
            step += 1
    late = in_table & (since > at)
    miss = np.where(gone, 1, np.where(~found, 2, np.where(late, 3, 0))).astype(np.int8)
    rows = pa.array(np.flatnonzero(miss))
    return pa.table([refs["ref_id"].take(rows), refs["ref_field"].take(rows), refs["at_us"].take(rows), pa.array(miss[miss > 0])], schema=_OUT)


def known_keys(parents: DataFrame, removals: DataFrame) -> DataFrame:
    """One row a key of a table or of its removal log: first instant, and the log's changes of state in order.

    Entries that repeat the state before them are left out, so that the log
    of a key holds only real changes.
    """
    firsts = parents.where("key is not null").groupBy("ref_field", "key").agg(F.min("since_us").alias("since_us")).select("*", F.lit(True).alias("in_table"), F.lit(None).cast("array<struct<at_us:bigint,n:bigint,removed:boolean>>").alias("log"))
    w = Window.partitionBy("ref_field", "key").orderBy("at_us", "n")
    changes = removals.where("key is not null and at_us is not null").withColumn("before", F.lag("removed").over(w)).where("before is null or before <> removed")
    logs = changes.groupBy("ref_field", "key").agg(F.sort_array(F.collect_list(F.struct("at_us", "n", "removed"))).alias("log"))
    dateless = removals.where("key is not null and at_us is null").select("ref_field", "key").distinct()
    named = logs.unionByName(dateless, allowMissingColumns=True).select("ref_field", "key", F.lit(None).cast("bigint").alias("since_us"), F.lit(False).alias("in_table"), "log")
    both = firsts.unionByName(named).groupBy("ref_field", "key").agg(F.min("since_us").alias("since_us"), F.max("in_table").alias("in_table"), F.max("log").alias("log"))
    return both.select(*_hashes(), "since_us", "in_table", F.coalesce("log", F.array().cast("array<struct<at_us:bigint,n:bigint,removed:boolean>>")).alias("log"))


def orphan_references(refs: DataFrame, parents: DataFrame, removals: DataFrame, batch_rows: int = 1 << 18) -> DataFrame:
    """References that found no record at their instant.

    :param refs: ref_id bigint, ref_field string, key string, at_us bigint.
    :param parents: ref_field, key, since_us; any number of rows a key.
    :param removals: ref_field, key, at_us, n (order within an instant), removed boolean.
    :param batch_rows: references probed at once.
    :return: ref_id, ref_field, at_us, miss_kind; one row a miss.
    """
    spark = refs.sparkSession
    naming = parents.count() + removals.count()
    ranges = 1 << min(int(math.log2(MAX_RANGES)), max(4, math.ceil(math.log2(shuffle_partitions(spark))), math.ceil(math.log2(max(1, naming / RANGE_KEYS)))))
    bits = int(math.log2(ranges))
    ranged = F.expr(f"cast(shiftrightunsigned(h1, {64 - bits}) as int)")
    probes = refs.where("key is not null").select("ref_id", "ref_field", "at_us", *_hashes()).withColumn("range", ranged)
    # a row a crowded range, at most one in batch_rows references
    crowded = keep(probes.groupBy("range").count().where(F.col("count") > batch_rows).select("range", F.ceil(F.col("count") / batch_rows).cast("int").alias("parts")), "crowded")
    parts = F.coalesce("parts", F.lit(1))
    probes = probes.join(crowded, "range", "left").withColumn("part", F.pmod(F.xxhash64("ref_id", F.lit(7)), parts).cast("int")).drop("parts")
    arrays = (
        known_keys(parents, removals)
        .withColumn("range", ranged)
        .groupBy("range")
        .agg(F.sort_array(F.collect_list(F.struct("h1", "h2", "since_us", "in_table", "log"))).alias("known"))
        .join(crowded, "range", "left")
        .select("range", "known", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    )
    missed = probes.groupBy("range", "part").cogroup(arrays.groupBy("range", "part")).applyInArrow(_probe, "ref_id bigint, ref_field string, at_us bigint, miss tinyint")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("miss").cast("int"))
    return missed.distinct().select("ref_id", "ref_field", "at_us", kind.alias("miss_kind"))


FIELDS = {"source_id": "source", "content_sha256": "version", "derivation_id": "derivation"}
TABLES = {"source_id": "source_records", "content_sha256": "content_versions", "derivation_id": "extracted_payloads"}


def citation_orphans(citations: DataFrame, records: DataFrame, versions: DataFrame, payloads: DataFrame, removals: DataFrame, **options: int) -> DataFrame:
    """Citations' references to sources, contents and derivations that weren't there when cited."""
    refs = citations.select(
        F.col("citation_key").alias("ref_id"), micros("cited_at").alias("at_us"), F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), norm_key(f).alias("key")) for f in FIELDS])).alias("r")
    ).select("ref_id", "at_us", "r.*")

    def parent(df: DataFrame, field: str, key: str, since: F.Column) -> DataFrame:
        return df.select(F.lit(field).alias("ref_field"), norm_key(key).alias("key"), since.alias("since_us"))

    parents = (
        parent(records, "source_id", "source_id", instant_us("created_at"))
        .unionByName(parent(versions, "content_sha256", "sha256", instant_us("first_seen_at")))
        .unionByName(parent(payloads, "derivation_id", "derivation_id", micros("created_at")))
    )
    field = F.create_map(*[F.lit(x) for f, k in FIELDS.items() for x in (k, f)])
    log = removals.select(
        F.try_element_at(field, F.col("record_kind")).alias("ref_field"), norm_key("record_key").alias("key"), micros("recorded_at").alias("at_us"), F.col("removal_id").alias("n"), (F.col("change_kind") == "removed").alias("removed")
    ).where("ref_field is not null and removed is not null")
    return orphan_references(refs, parents, log, **options)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references counted per referenced table, month of citing and kind."""
    table = F.create_map(*[F.lit(x) for pair in TABLES.items() for x in pair])
    month = F.date_format(F.timestamp_micros("at_us"), "yyyy-MM")
    return orphans.groupBy(F.try_element_at(table, F.col("ref_field")).alias("ref_table"), month.alias("month"), "miss_kind").agg(F.count("*").alias("n_references"), F.count_distinct("ref_id").alias("n_citations"))
