"""Positions in one global order, pages and bounded samples, without a single sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.hashing import text_sha256
from quillspark.session import keep


def number_rows(df: DataFrame, by: list[str], name: str = "ordinal") -> DataFrame:
    """Positions from 1 in the order of the columns: ranges are counted, then numbered on their own."""
    ranged = keep(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = ranged.groupBy("_part").count()  # one row a partition
    starts = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return ranged.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_own")).cast("bigint")).drop("_part", "_own", "_start")


def paged(df: DataFrame, by: list[str], size: int) -> DataFrame:
    """Rows with ordinal and page (from 0)."""
    return number_rows(df, by).withColumn("page", F.floor((F.col("ordinal") - 1) / size).cast("bigint"))


def page_index(pages: DataFrame, row: F.Column) -> DataFrame:
    """page, first, last, n and digest of each page; a page is bounded by its size."""
    return pages.groupBy("page").agg(
        F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.count("*").alias("n"),
        text_sha256(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", row.alias("row")))), lambda x: x["row"]), "\n")).alias("digest"),
    )


def run_proof(index: DataFrame) -> DataFrame:
    """One row: number of pages and rows, whether pages are contiguous, and a digest over the index."""
    # the index has a row a page; it is hashed in two levels as it may be long
    leaves = index.groupBy(F.floor(F.col("page") / 1000).alias("b")).agg(
        text_sha256(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "digest"))), lambda x: x["digest"]), "\n")).alias("leaf"), F.count("*").alias("pages"), F.sum("n").alias("n"), F.max("page").alias("last"), F.max("last_ordinal").alias("end")
    )
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "leaf"))), lambda x: x["leaf"]), "\n")
    return leaves.agg(
        F.coalesce(F.sum("pages"), F.lit(0)).cast("bigint").alias("n_pages"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_matches"),
        ((F.coalesce(F.max("last") + 1, F.lit(0)) == F.coalesce(F.sum("pages"), F.lit(0))) & (F.coalesce(F.max("end"), F.lit(0)) == F.coalesce(F.sum("n"), F.lit(0)))).alias("complete"), text_sha256(top).alias("digest"),
    )


def bounded_sample(df: DataFrame, key: list[str], size: F.Column, most: int = 100, most_bytes: int = 32 << 10) -> DataFrame:
    """The smallest keys, at most so many rows and bytes: rows in order of key, skipping what doesn't fit any more.

    Only the first ``most`` rows are ever gathered; total is the exact number of all rows.
    """
    top = df.withColumn("_size", size.cast("bigint")).orderBy(*key).limit(most)
    rows = top.agg(F.array_sort(F.collect_list(F.struct(*key, *[c for c in top.columns if c not in key]))).alias("rows"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept"))
    pos = F.transform("rows", lambda r, i: F.struct(r["_size"].alias("s"), i.alias("i")))
    fold = F.aggregate(pos, zero, lambda acc, r: F.when(acc["used"] + r["s"] <= most_bytes, F.struct((acc["used"] + r["s"]).alias("used"), F.concat(acc["kept"], F.array(r["i"])).alias("kept"))).otherwise(acc))
    kept = rows.withColumn("kept", fold["kept"]).select(F.explode(F.filter("rows", lambda r, i: F.array_contains("kept", i))).alias("r")).select("r.*").drop("_size")
    return kept.withColumn("total", F.lit(df.count()))


def smallest(df: DataFrame, key: list[str], n: int = 100) -> DataFrame:
    return df.orderBy(*key).limit(n)
