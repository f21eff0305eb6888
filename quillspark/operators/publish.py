"""Changes of a set of documents as a whole: differences, guards, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (added, removed, changed), before, after of what differs."""
    a, b = before.select(key, F.col(value).alias("before"), F.lit(True).alias("in_a")), after.select(key, F.col(value).alias("after"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"), "before", "after").where("change is not null")


def dropped(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that a change loses, as often as it loses them."""
    return before.exceptAll(after)


def same_set(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def missing_from(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys of a that b lacks: empty where a is a subset."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def staged_problems(manifest: DataFrame, staged: DataFrame) -> DataFrame:
    """Writes of a change set whose text is missing or has another hash than the manifest says.

    :param manifest: path, operation, sha256; :param staged: path, text.
    """
    joined = manifest.where("operation = 'write'").join(staged.select("path", F.sha2(F.encode("text", "UTF-8"), 256).alias("got")), "path", "left")
    return joined.where(~F.col("sha256").eqNullSafe(F.col("got"))).select("path", F.when(F.col("got").isNull(), "not_staged").otherwise("hash_differs").alias("code"))


def apply_changes(before: DataFrame, manifest: DataFrame, staged: DataFrame) -> DataFrame:
    """The documents after a change set: path, text."""
    kept = before.select("path", "text").join(manifest.select("path").distinct(), "path", "left_anti")
    written = manifest.where("operation = 'write'").select("path").distinct().join(staged.select("path", "text"), "path")
    return kept.unionByName(written)
