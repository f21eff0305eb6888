"""Reconciling a snapshot of live files with the ledger.

Every path gets one decision. Files are matched by path first; what is left is
matched by content (files) or address (descriptors), and only where exactly one
new file meets exactly one missing record it is a rename.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("create", "retain", "process", "rename", "ambiguous", "missing", "integrity_error", "obscured")
STATES = ("pending", "extracting", "ok", "warning", "needs_agent", "failed", "unsupported", "integrity_error", "awaiting_approval")


def content_key(url: Column, sha256: Column) -> Column:
    return F.when(url.isNotNull(), F.concat(F.lit("url:"), url)).otherwise(F.concat(F.lit("sha256:"), sha256))


def changed_metadata(a: str, b: str) -> Column:
    """Whether size or mtime differ, so that the content must be hashed again."""
    return ~(F.col(f"{a}.byte_size").eqNullSafe(F.col(f"{b}.byte_size")) & F.col(f"{a}.mtime_ns").eqNullSafe(F.col(f"{b}.mtime_ns")))


def rename_groups(unmatched: DataFrame) -> DataFrame:
    """key, n_new, n_gone and the only missing record, of keys that new files and missing records share.

    :param unmatched: key, is_new, source_id.
    """
    rows = unmatched.where("key is not null")
    groups = rows.groupBy("key").agg(F.count_if("is_new").alias("n_new"), F.count_if(~F.col("is_new")).alias("n_gone"), F.min(F.when(~F.col("is_new"), F.col("source_id"))).alias("only"))
    return groups.where("n_new > 0 and n_gone > 0")


def reconcile(live: DataFrame, ledger: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """path, source_id, action.

    The two sides meet by path; what is left over is counted by key, and every
    row is judged in one pass with the counts of its key, so that no pairs of
    equal keys are ever formed.

    :param live: path, byte_size, mtime_ns, sha256, url; one row a path.
    :param ledger: source_id, path, byte_size, mtime_ns, sha256, url.
    :param skipped: path of what couldn't be read; records at or under it are obscured, and all of them by a skip without a path.
    """
    both = live.dropDuplicates(["path"]).alias("l").join(ledger.alias("r"), F.col("l.path") == F.col("r.path"), "full_outer")
    same = F.col("l.sha256").eqNullSafe(F.col("r.sha256")) & F.col("l.url").eqNullSafe(F.col("r.url"))
    untouched = ~changed_metadata("l", "r") & F.col("l.sha256").isNull() & F.col("l.url").eqNullSafe(F.col("r.url"))
    met = F.col("l.path").isNotNull() & F.col("r.path").isNotNull()
    is_new = F.col("r.path").isNull()
    key = F.when(is_new, content_key(F.col("l.url"), F.col("l.sha256"))).otherwise(content_key(F.col("r.url"), F.col("r.sha256")))
    action = F.when(met, F.when(untouched | same, "retain").when(F.col("l.url").isNotNull(), "process").otherwise("integrity_error")).otherwise(F.when(is_new, "create").otherwise("missing"))
    rows = both.select(F.coalesce("l.path", "r.path").alias("path"), F.col("r.source_id").alias("source_id"), met.alias("met"), is_new.alias("is_new"), F.when(~met, key).alias("key"), action.alias("action"))
    if skipped is not None:
        # every folder above a path is a key, so that it is an equal join
        parts = F.split("path", "/")
        gone = rows.where("action = 'missing'").select("path", "source_id")
        at = gone.withColumn("above", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
        everything = skipped.where("path is null").select(F.lit(True).alias("every")).limit(1)
        scopes = skipped.where("path is not null").select(F.col("path").alias("above")).distinct()
        # one row at most is joined to all
        hidden = at.join(scopes, "above", "left_semi").select("path", "source_id").unionByName(gone.join(F.broadcast(everything)).select("path", "source_id")).distinct()
        rows = rows.join(hidden.withColumn("hidden", F.lit(True)), ["path", "source_id"], "left")
        rows = rows.withColumns({"key": F.when(F.col("hidden").isNull(), F.col("key")), "action": F.when(F.col("hidden"), "obscured").otherwise(F.col("action"))}).drop("hidden")
    # rows without a key meet no group; a key of their own spreads them over all partitions
    groups = rename_groups(rows.where("key is not null"))
    joined = rows.withColumn("key", F.coalesce("key", F.concat(F.lit("none:"), "path"))).join(groups, "key", "left")
    one = F.coalesce((F.col("n_new") == 1) & (F.col("n_gone") == 1), F.lit(False))
    kept = joined.where(~(one & ~F.col("is_new")))
    return kept.select("path", F.when(one, F.col("only")).otherwise(F.col("source_id")).alias("source_id"), F.when(F.col("n_new").isNull(), F.col("action")).when(one, "rename").otherwise("ambiguous").alias("action"))


def zero_filled(counted: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of a column over all its allowed values, zeros included; other values are left out."""
    base = counted.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    got = counted.groupBy(column).agg(F.count("*").alias("n"))
    return base.join(got, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def next_state(state: Column, action: Column, outcome: Column, adopted: Column) -> Column:
    """State after a sync: changed bytes stay an integrity error until they are adopted, interrupted work starts again."""
    return (
        F.when((action == "integrity_error") & ~F.coalesce(adopted, F.lit(False)), "integrity_error")
        .when(action == "missing", F.when(state == "awaiting_approval", state).otherwise("warning"))
        .when(state == "extracting", "pending")
        .when(action.isin("create", "process") | (action == "integrity_error"), F.coalesce(outcome, F.lit("pending")))
        .otherwise(state)
    )


def retry_needed(attempt: str, current: str, forced: Column | None = None) -> Column:
    """No attempt yet, an interrupted one, one forced, or one whose five identity fields changed."""
    fields = ("input_sha256", "extractor_id", "extractor_version", "config_sha256", "prerequisite_digest")
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f"{attempt}.{f}").eqNullSafe(F.col(f"{current}.{f}"))
    return F.col(attempt).isNull() | (F.coalesce(F.col(f"{attempt}.outcome"), F.lit("interrupted")) == "interrupted") | changed | (forced if forced is not None else F.lit(False))


def is_current(active_derivation_id: Column, expected_derivation_id: Column) -> Column:
    return active_derivation_id.eqNullSafe(expected_derivation_id)


COVERAGE_STATES = tuple(s for s in STATES if s not in ("ok", "extracting"))


def coverage_gaps(records: DataFrame, skipped: DataFrame) -> DataFrame:
    """source_id, code, path of all that a search can't cover: skips, and each diagnosis of a source in a state that leaves it out.

    :param records: source_id, state, path, codes (array; a source without any gets the name of its state); :param skipped: path, code.
    """
    codes = F.when(F.size(F.coalesce("codes", F.array().cast("array<string>"))) > 0, F.col("codes")).otherwise(F.array(F.concat(F.lit("source_"), F.col("state"))))
    own = records.where(F.col("state").isin(*COVERAGE_STATES)).select("source_id", F.explode(codes).alias("code"), "path")
    return skipped.select(F.lit(None).cast("string").alias("source_id"), "code", "path").unionByName(own)


def descriptor_change(old_url: Column, old_description: Column, url: Column, description: Column) -> Column:
    """What an edit of a URL descriptor means: a new description keeps the source, a new address clears what is active."""
    return F.when(~url.eqNullSafe(old_url), "address_changed").when(~description.eqNullSafe(old_description), "described_anew").otherwise("unchanged")


def adopt_versions(errors: DataFrame, approvals: DataFrame) -> DataFrame:
    """Adoption events of integrity errors that were approved: prior_sha256 and adopted_sha256 must be those of the approval."""
    return errors.join(approvals, ["source_id", "prior_sha256", "adopted_sha256"]).select("source_id", "prior_sha256", "adopted_sha256", "approval_note", "recorded_at")


def chain_breaks(events: DataFrame, versions: DataFrame, records: DataFrame) -> DataFrame:
    """source_id, event_id (null for the source as a whole) and the first thing wrong with the source's chain of adoptions.

    The chain begins at a held content, each adoption takes up what the one
    before adopted, adopts a held content that was not there before, not earlier
    than the one before, at the moment that content was first seen; it covers
    all held contents, and its end is the active one.

    :param events: source_id, event_id, prior_sha256, adopted_sha256, at_us; :param versions: source_id, sha256, since_us, one row a content; :param records: source_id, active.
    """
    w = Window.partitionBy("source_id").orderBy("at_us", "event_id")
    held = lambda c: versions.select("source_id", F.col("sha256").alias(f"{c}_sha256"), F.col("since_us").alias(f"{c}_us"))
    chained = events.join(held("prior"), ["source_id", "prior_sha256"], "left").join(held("adopted"), ["source_id", "adopted_sha256"], "left")
    again = F.row_number().over(Window.partitionBy("source_id", "adopted_sha256").orderBy("at_us", "event_id")) > 1
    chained = chained.select("*", again.alias("again"), F.first("prior_sha256").over(w).alias("root"), F.lag("adopted_sha256").over(w).alias("before"), F.coalesce(F.lag("at_us").over(w), F.col("prior_us")).alias("before_us"))
    problem = (
        F.when(F.col("before").isNull() & F.col("prior_us").isNull(), "root_not_held")
        .when(F.col("before") != F.col("prior_sha256"), "prior_mismatch")
        .when(F.col("again") | (F.col("adopted_sha256") == F.col("root")), "adopted_again")
        .when(F.col("adopted_us").isNull(), "adopted_not_held")
        .when(F.col("prior_us").isNull(), "prior_not_held")
        .when(F.col("at_us") < F.col("before_us"), "not_later")
        .when(F.col("adopted_us") != F.col("at_us"), "first_seen_differs")
    )
    broken = chained.select("source_id", "event_id", problem.alias("problem")).where("problem is not null")
    ends = events.groupBy("source_id").agg(F.max_by("adopted_sha256", F.struct("at_us", "event_id")).alias("last"), F.min_by("prior_sha256", F.struct("at_us", "event_id")).alias("root"))
    members = events.select("source_id", F.col("adopted_sha256").alias("sha256")).unionByName(ends.select("source_id", F.col("root").alias("sha256"))).distinct().withColumn("inside", F.lit(True))
    # without adoptions a source holds one content
    alone = versions.groupBy("source_id").agg(F.count("*").alias("n_held"), F.min("sha256").alias("only"))
    outside = versions.join(members, ["source_id", "sha256"], "left").join(alone, "source_id").join(ends, "source_id", "left").where(F.col("inside").isNull() & (F.col("last").isNotNull() | (F.col("n_held") > 1))).select("source_id").distinct()
    end = records.join(ends, "source_id", "left").join(alone, "source_id", "left").where(~F.col("active").eqNullSafe(F.coalesce("last", "only"))).select("source_id").distinct()
    whole = outside.withColumn("problem", F.lit("held_outside_chain")).unionByName(end.withColumn("problem", F.lit("active_not_last")))
    return broken.unionByName(whole.select("source_id", F.lit(None).cast("bigint").alias("event_id"), "problem"))
