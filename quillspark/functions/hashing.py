"""Content identities and digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\0"


def text_sha256(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def source_id(path: Column, content_sha256: Column) -> Column:
    """Identity of a source by its first path and content."""
    return F.concat(F.lit("src_"), text_sha256(F.concat(F.lit("source-v1" + NUL), path, F.lit(NUL), content_sha256)))


def derivation_id(source_sha256: Column, extractor: Column, version: Column, config_sha256: Column) -> Column:
    return F.concat(F.lit("drv_"), text_sha256(F.concat_ws(NUL, source_sha256, extractor, version, config_sha256)))


def handoff_id(canonical_json: Column) -> Column:
    return F.concat(F.lit("hnd_"), text_sha256(canonical_json))


def effective_version(version: Column, digest: Column) -> Column:
    return F.concat(version, F.lit("+"), digest)


def split_version(effective: Column) -> Column:
    """struct of version and digest, parted at the last plus sign."""
    return F.struct(F.regexp_extract(effective, r"^(.*)\+[^+]*$", 1).alias("version"), F.regexp_extract(effective, r"\+([^+]*)$", 1).alias("digest"))


def revision_rows(sources: DataFrame) -> DataFrame:
    """source_id and the row that stands for it in a revision."""
    row = F.concat(F.col("source_id"), F.lit(NUL), F.coalesce("active_content_sha256", F.lit("")), F.lit(NUL), F.coalesce("active_derivation_id", F.lit("")))
    return sources.select("source_id", row.alias("row"))


def corpus_revision(sources: DataFrame) -> DataFrame:
    """One row: sha256 over all sorted rows, and their number.

    A single hash over all rows can't be combined of parts, so the sorted rows
    are streamed through the driver, a partition at a time.
    """
    digest, n = hashlib.sha256(), 0
    for r in revision_rows(sources).orderBy("row").toLocalIterator():
        digest.update((b"\n" if n else b"") + r.row.encode())
        n += 1
    return sources.sparkSession.createDataFrame([(digest.hexdigest(), n)], "revision string, n_sources bigint")


def tree_digest(rows: DataFrame, group: list[Column], buckets: list[Column], row: Column) -> DataFrame:
    """Digest of ordered rows as a tree: rows by the finest bucket, their digests by the next, and so on up to the group.

    :param buckets: from coarse to fine, each a part of the one before, so that no array holds more than a bucket's rows or a bucket's buckets.
    :return: the group columns, digest, n.
    """
    names = [f"g{k}" for k in range(len(group))]
    keys = [f"b{k}" for k in range(len(buckets))]
    level = rows.select(*[c.alias(n) for c, n in zip(group + buckets, names + keys)], row.alias("row"))
    level = level.groupBy(*names, *keys).agg(text_sha256(F.array_join(F.array_sort(F.collect_list("row")), "\n")).alias("digest"), F.count("*").alias("n"))
    while keys:
        last = keys.pop()
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(last, "digest"))), lambda x: x["digest"]), "\n")
        level = level.groupBy(*names, *keys).agg(text_sha256(joined).alias("digest"), F.sum("n").alias("n"))
    return level
