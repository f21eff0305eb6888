"""Mixing sources to target weights by capped water-filling.

Each source gets its share of the total size, but no more than ``max_repeats``
times what it has. What a clamped source can't take is shared out among the
others in proportion to their targets, until nothing exceeds its cap. A source
is repeated a whole number of times, and the fraction left over is filled with
its rows in an order seeded by hash, up to the row nearest to the wanted size.

The order is never sorted as a whole: a histogram over 4,096 ranges of the
hash finds the range in which the fraction ends, and only that range's rows
are put in order, so that a source with a third of all rows is no hot group.

Defined results: source names compare without regard to case, outer blanks and
``_`` for ``-``; rows without a source, with one that has no target, or of size
0 or null are no part of the mixture; a target without rows stays in the report
with share 0; targets that name one source twice are added up, and the greater
max_repeats holds; a null or negative target counts as 0, a null max_repeats
as 1. With no rows or no targets the mixture is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.keys import BLANKS
from quillspark.session import keep

MAX_SOURCES = 10_000  # rows of the table of targets that the driver solves
BUCKET_BITS = 12


def norm_source(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit("_"), F.lit("-"))


def water_fill(sizes: list[float], shares: list[float], repeats: list[float], total: float) -> list[float]:
    """Size each source is given: proportional to shares, clamped at size x repeats, excess passed on."""
    given = [0.0] * len(sizes)
    free = {i for i, (n, w, r) in enumerate(zip(sizes, shares, repeats)) if n > 0 and w > 0 and r > 0}
    rest = total
    while free and rest > 0:
        weight = sum(shares[i] for i in free)
        over = {i for i in free if rest * (shares[i] / weight) > sizes[i] * repeats[i]}
        if not over:
            for i in free:
                given[i] = rest * (shares[i] / weight)
            break
        for i in over:
            given[i] = sizes[i] * repeats[i]
        rest -= sum(given[i] for i in over)
        free -= over
    return given


def plan_mix(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """A row for each target: source, target_share, max_repeats, available, given, epochs, whole, fraction."""
    share, repeats = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)), F.coalesce("max_repeats", F.lit(1))
    goals = targets.select(norm_source("source").alias("source"), share.alias("target_share"), repeats.alias("max_repeats")).where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    has = sized.groupBy("source").agg(F.sum("size").alias("available"))
    rows = goals.join(has, "source", "left").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    sizes = [r.available or 0 for r in rows]
    given = water_fill(sizes, [r.target_share for r in rows], [r.max_repeats for r in rows], sum(sizes) if total is None else total)
    plan = []
    for r, n, g in zip(rows, sizes, given):
        epochs = g / n if n else 0.0
        whole = int(epochs + 1e-9)
        plan.append((r.source, float(r.target_share), int(r.max_repeats), int(n), float(g), float(epochs), whole, max(0.0, epochs - whole) * n))
    return sized.sparkSession.createDataFrame(plan, "source string, target_share double, max_repeats int, available bigint, given double, epochs double, whole int, part double")


def sample_mix(sized: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """id, source, size and copies (at least one) of every row of the mixture."""
    hashed = sized.withColumn("h", F.xxhash64(F.lit(seed), "id", "size")).withColumn("bucket", F.expr(f"shiftrightunsigned(h, {64 - BUCKET_BITS})"))
    bars = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    goals = plan.where("given > 0").select("source", "whole", "part")
    # the bucket in which the fraction ends, and how much of it is wanted
    ends = bars.withColumn("upto", upto).join(goals, "source").where("upto > part and upto - n <= part").select("source", F.col("bucket").alias("last"), (F.col("part") - (F.col("upto") - F.col("n"))).alias("wanted"))
    rows = hashed.join(F.broadcast(goals), "source").join(F.broadcast(ends), "source", "left")  # both at most MAX_SOURCES rows
    edge = rows.where("bucket = last")
    before = F.sum("size").over(Window.partitionBy("source").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    edge = edge.withColumn("extra", (before <= F.col("wanted")).cast("int"))
    rest = rows.where("last is null or bucket <> last").withColumn("extra", F.coalesce((F.col("bucket") < F.col("last")).cast("int"), F.lit(0)))
    return rest.unionByName(edge).select("id", "source", "size", (F.col("whole") + F.col("extra")).alias("copies")).where("copies > 0")


def mix_sources(rows: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mixture and the report of the shares reached.

    :param rows: id, source, size.
    :param total: wanted size of the mixture; without one, the size of all rows that have a target.
    """
    sized = keep(rows.select("id", norm_source("source").alias("source"), "size").where("source is not null and size > 0"), "mix")
    plan = plan_mix(sized, targets, total)
    mixture = sample_mix(sized, plan, seed)
    got = mixture.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("actual"), F.count("*").alias("n_rows"), F.max("copies").alias("most_copies"))
    everything = Window.partitionBy()
    actual = F.coalesce("actual", F.lit(0))
    report = plan.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "available", "epochs", (F.col("epochs") >= F.col("max_repeats") - 1e-9).alias("clamped"), F.col("given").alias("planned"), actual.alias("actual"),
        F.coalesce(actual / F.nullif(F.sum(actual).over(everything), F.lit(0)), F.lit(0.0)).alias("actual_share"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return mixture, report
