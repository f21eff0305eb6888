"""Evidence packets of three search passes, and references for and against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.search import PASSES


def packet(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: whether the three passes make a valid packet, the revision, and the number of distinct evidence rows.

    :param runs: search_pass, run_id, revision, complete; :param evidence: run_id and identity columns.
    """
    checks = runs.agg(
        (F.count("*") == len(PASSES)).alias("three"), (F.array_sort(F.collect_set("search_pass")) == F.array(*[F.lit(p) for p in sorted(PASSES)])).alias("passes"),
        (F.count_distinct("run_id") == len(PASSES)).alias("distinct_runs"), (F.count_distinct("revision") == 1).alias("one_revision"), F.coalesce(F.bool_and("complete"), F.lit(False)).alias("complete"), F.min("revision").alias("revision"), F.lit(1).alias("k"),
    )
    identity = [c for c in evidence.columns if c != "run_id"]
    n = evidence.join(runs.select("run_id"), "run_id", "left_semi").select(identity).distinct().agg(F.count("*").alias("n_evidence"), F.lit(1).alias("k"))
    return checks.join(n, "k").select((F.col("three") & F.col("passes") & F.col("distinct_runs") & F.col("one_revision") & F.col("complete")).alias("valid"), "revision", "n_evidence")


def reference_problems(support: DataFrame, counter: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """References that aren't known citations, and those given both for and against."""
    both = support.select(key).distinct().join(counter.select(key).distinct(), key, "left_semi").withColumn("code", F.lit("support_and_counter"))
    unknown = support.select(key).unionByName(counter.select(key)).distinct().join(known.select(key).distinct(), key, "left_anti").withColumn("code", F.lit("unknown_citation"))
    return both.unionByName(unknown)


def one_revision(reports: DataFrame) -> DataFrame:
    """Revisions of merged reports, if there is more than one."""
    revisions = reports.select("revision").distinct()
    return revisions.withColumn("n", F.lit(revisions.count())).where("n > 1")
