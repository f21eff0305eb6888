"""Near-duplicate texts by a chosen-path join.

A text is the set of its sequences of five successive words. Texts with equal
sets are one class; only one representative of a class takes part in the join.
Each set is sampled once by ``WIDTH`` minimum hashes: the token with the least
hash under each seed. A run of the join puts every set into the bucket of a
path of sampled tokens. How many tokens the paths begin with follows from how
alike a few sampled sets are, so that the first buckets aren't all too large to
compare; a bucket of more than ``LIMIT`` sets is split by ``BRANCHES`` further
tokens chosen by its path, level by level, and smaller buckets are compared by
brute force. No path draws a token twice. Runs are repeated until a pair at the
threshold is met with the wanted recall even if its buckets are split on every
level, the spread of the number of sampled tokens that such a pair shares
included.
Comparing in a bucket uses a sketch of four bits of each sampled token; the
pairs it lets through are checked exactly on the texts.

Defined results: null, empty and blank texts and those of fewer than five words
have no sequences and are in no pair; repeated rows of an id count once; equal
texts have similarity 1. On the last level whole buckets are compared, whatever
their size, so that no pair is lost to a cap: a bucket of more than LIMIT sets
is cut into parts, and each two parts meet in a bucket of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import bounded_batches, keep

WORDS = 5
WIDTH = 64
LIMIT = 512
BRANCHES = 8
DEPTH = 6
SAMPLE = 1000  # sets that the first depth is estimated from
SKETCH = ("s1", "s2", "s3", "s4")
RECALL = 0.99
RUNS_MOST = 512  # runs are named by nine bits of a path
_RUN_BITS = np.uint64(RUNS_MOST - 1)
HOT_SHARE = 1000  # a bucket with more than one in so many rows is split without being gathered
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 31, WIDTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, WIDTH, dtype=np.uint64).astype(np.uint32)
_POWERS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def recall(similarity: float, first: int, runs: int) -> float:
    """Probability that a pair at the threshold meets in a bucket of the last level.

    Of the WIDTH sampled tokens such a pair shares a binomial number; all runs
    draw from these. A run keeps the pair if all tokens that it begins with are
    shared, and at least one of BRANCHES on each of the levels that follow.
    """
    k = np.arange(WIDTH + 1)
    weight = np.array([math.comb(WIDTH, int(x)) * similarity ** int(x) * (1 - similarity) ** (WIDTH - int(x)) for x in k])
    meet = np.ones(WIDTH + 1)
    for i in range(first):
        meet *= np.maximum(k - i, 0) / (WIDTH - i)
    none = np.ones(WIDTH + 1)
    for i in range(BRANCHES):
        none *= np.maximum(WIDTH - k - i, 0) / (WIDTH - first - i)
    meet *= (1 - np.minimum(none, 1)) ** (DEPTH - 1)
    return float((weight * (1 - (1 - meet) ** runs)).sum())


def runs_needed(similarity: float, first: int, wanted: float = RECALL) -> int:
    """Runs after which a pair at the threshold is met with the wanted probability; RUNS_MOST where these don't suffice."""
    low, high = 1, RUNS_MOST
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if recall(similarity, first, middle) >= wanted else (middle + 1, high)
    return low


def first_depth(best: np.ndarray, total: int) -> int:
    """Tokens that paths begin with: as many as make a set's bucket smaller than LIMIT / 4 on the average."""
    if len(best) < 2:
        return 1
    alike = np.stack([(best == row).mean(1) for row in best])
    np.fill_diagonal(alike, 0)
    for d in range(1, 5):
        if (alike**d).sum() / (len(best) * (len(best) - 1)) * total <= LIMIT / 4:
            return d
    return 5


def word_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of the word sequences of each text."""
    words = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{Nd}]+")
    flat = words.flatten()
    coded = flat.dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()], np.uint64)
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    sizes = np.add.reduceat(np.r_[filled, False].astype(np.int64), words.offsets.to_numpy()[:-1]) if len(words) else np.zeros(0, np.int64)
    sizes[np.diff(words.offsets.to_numpy()) == 0] = 0
    h = (hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, np.uint64))[filled]
    ends = np.cumsum(sizes)
    if len(h) < WORDS:
        return [np.zeros(0, np.uint64)] * len(texts)
    with np.errstate(over="ignore"):
        rolled = mix64(reduce(np.add, [h[k : len(h) - WORDS + 1 + k] * _POWERS[k] for k in range(WORDS)]))
    return [np.unique(rolled[a : max(a, b - WORDS + 1)]) for a, b in zip(ends - sizes, ends)]


def minima(tokens: np.ndarray) -> np.ndarray:
    """The set's least hash under each seed."""
    low = (tokens >> np.uint64(16)).astype(np.uint32)
    best = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 4096):
        part = low[a : a + 4096]
        x = np.multiply.outer(_A, part)
        x += _B[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(best, x.min(1), out=best)
    return best


def sketch(best: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, as four 64-bit integers a row."""
    bits = mix64(best.astype(np.uint64) + _MIX) & np.uint64(15)
    shifts = (4 * np.arange(16)).astype(np.uint64)
    return np.bitwise_or.reduce(bits.reshape(*best.shape[:-1], 4, 16) << shifts, axis=-1)


def agreeing(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Number of minima whose four bits agree."""
    differ = np.zeros(len(x[0]), np.int16)
    for a, b in zip(x, y):
        d = a ^ b
        d |= d >> np.uint64(2)
        d |= d >> np.uint64(1)
        differ += np.bitwise_count(d & np.uint64(0x1111111111111111))
    return WIDTH - differ


def least_agreement(similarity: float) -> int:
    """Agreement that pairs at the threshold miss less than once in 2,000."""
    p = similarity + (1 - similarity) / 16
    return math.floor(WIDTH * p - 3.4 * math.sqrt(WIDTH * p * (1 - p)))


def sign_texts(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, n, set1, set2 (128 bits that stand for the set), minima and s1 to s4 (their sketch) of every text with a sequence."""
    bounded_batches(rows.sparkSession)
    kind = dict(rows.dtypes)[doc_id]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = word_sets(batch.column("text"))
            use = [i for i, s in enumerate(sets) if len(s)]
            if not use:
                continue
            best = np.stack([minima(sets[i]) for i in use])
            drawn = sketch(best).view(np.int64)
            names = [xxhash.xxh3_128_intdigest(sets[i].tobytes()) for i in use]
            halves = np.array([[n >> 64, n & 0xFFFFFFFFFFFFFFFF] for n in names], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(use)), pa.array([len(sets[i]) for i in use], pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([b.tobytes() for b in best]), *[pa.array(drawn[:, c].copy()) for c in range(4)]],
                names=["doc", "n", "set1", "set2", "minima", *SKETCH],
            )

    texts = rows.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    return texts.mapInArrow(sign, f"doc {kind}, n int, set1 bigint, set2 bigint, minima binary, s1 bigint, s2 bigint, s3 bigint, s4 bigint")


def _paths(level: int, runs: int, first: int):
    """Bucket keys of each row: the first tokens of all runs, or the further tokens that a full bucket's path chooses."""
    orders = _orders(runs, first)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            best = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(n, WIDTH).astype(np.uint64)
            made = []
            with np.errstate(over="ignore"):
                if level:
                    path, rows = batch.column("key").to_numpy().view(np.uint64), np.arange(n)
                    run = (path & _RUN_BITS).astype(np.int64)
                    for j in range(BRANCHES):
                        place = orders[run, first + BRANCHES * (level - 1) + j]
                        made.append((mix64(mix64(path + np.uint64(j + 1) * _MIX) ^ (best[rows, place] + (place.astype(np.uint64) << np.uint64(32)))) & ~_RUN_BITS) | run.astype(np.uint64))
                else:
                    for run in range(runs):
                        path = np.zeros(n, np.uint64)
                        for place in orders[run, :first]:
                            path = mix64(mix64(path + _MIX) ^ (best[:, place] + (np.uint64(place) << np.uint64(32))))
                        made.append((path & ~_RUN_BITS) | np.uint64(run))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64)), *[pa.concat_arrays([batch.column(c)] * len(made)) for c in ("doc", *SKETCH)]], names=["key", "doc", *SKETCH])

    return keys


def _orders(runs: int, first: int) -> np.ndarray:
    """The order in which each run draws the sampled tokens: those it begins with are drawn in turn, so that runs share as few as can be, and none is drawn twice."""
    rng = np.random.default_rng(7)
    waiting: list[int] = []
    out = np.empty((runs, WIDTH), np.int64)
    for r in range(runs):
        begin: list[int] = []
        while len(begin) < first:
            waiting = waiting or rng.permutation(WIDTH).tolist()
            place = next((p for p in waiting if p not in begin), None)
            if place is None:
                waiting = []
                continue
            waiting.remove(place)
            begin.append(place)
        out[r] = begin + [p for p in rng.permutation(WIDTH).tolist() if p not in begin]
    return out


def _compare(limit: int, least: int, last: bool):
    """Brute force within the runs of equal keys of a sorted partition; rows of full buckets come out with their key."""

    def pairs(key: np.ndarray, doc: np.ndarray, drawn: list[np.ndarray]) -> tuple[list, list]:
        left, right = [], []
        rows = np.arange(len(key))
        step = 1
        while True:
            rows = rows[rows + step < len(key)]
            rows = rows[key[rows] == key[rows + step]]
            if not len(rows):
                return left, right
            other = rows + step
            good = agreeing([x[rows] for x in drawn], [x[other] for x in drawn]) >= least
            if good.any():
                left.append(doc[rows[good]])
                right.append(doc[other[good]])
            step += 1

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        full: int | None = None

        def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
            nothing = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), nothing if b is None else pa.array(b), nothing if key is None else pa.array(key)], names=["a", "b", "key"])

        def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key = cols[0]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            over = np.repeat((sizes > limit) & (not last), sizes)
            if over.any():
                yield out(cols[1][over], None, key[over])
            single = np.repeat(sizes == 1, sizes)
            cols = [c[~over & ~single] for c in cols]
            left, right = pairs(cols[0], cols[1], [c.view(np.uint64) for c in cols[2:]])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                both = both[both[:, 0] < both[:, 1]]
                yield out(both[:, 0].copy(), both[:, 1].copy(), None)

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("key", "doc", *SKETCH)]
            if full is not None:
                same = cols[0] == full
                if same.any():
                    yield out(cols[1][same], None, cols[0][same])
                    cols = [c[~same] for c in cols]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut:
                yield from done([c[:cut] for c in cols])
            held, full = [c[cut:] for c in cols], None
            if len(held[0]) > limit and not last:
                full = int(held[0][0])
                yield out(held[1], None, held[0])
                held = None
        if held is not None:
            yield from done(held)

    return compare


def candidate_pairs(signed: DataFrame, similarity: float) -> DataFrame:
    """a < b of sets that met in a bucket and whose sketches agree.

    :param signed: doc bigint, minima and its sketch; one row a set.
    """
    spark = signed.sparkSession
    total = signed.count()
    sample = signed.where(F.pmod(F.xxhash64("doc", F.lit(9)), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, 1.2 * SAMPLE / max(1, total))))).select("minima").limit(SAMPLE).collect()
    first = first_depth(np.array([np.frombuffer(r.minima, np.uint32) for r in sample]), total)
    runs, least = runs_needed(similarity, first), least_agreement(similarity)
    schema = "a bigint, b bigint, key bigint"
    found: list[DataFrame] = []
    entering = signed
    for level in range(DEPTH):
        last = level == DEPTH - 1
        entries = entering.mapInArrow(_paths(level, runs, first), "key bigint, doc bigint, s1 bigint, s2 bigint, s3 bigint, s4 bigint")
        skipped = None
        if not last:
            hot = _hot_keys(entering, level, runs, first)
            if hot:
                keys = spark.createDataFrame([(k,) for k in hot], "key bigint")  # at most HOT_SHARE rows
                skipped = entries.join(F.broadcast(keys), "key", "left_semi").select(F.col("doc").alias("a"), F.lit(None).cast("bigint").alias("b"), "key")
                entries = entries.join(F.broadcast(keys), "key", "left_anti")
        else:
            entries = _parted(entries)
        met = entries.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(LIMIT, least, last), schema)
        met = keep(met.unionByName(skipped) if skipped is not None else met, f"met{level}")
        found.append(met.where("b is not null").select("a", "b"))
        over = met.where("b is null").select(F.col("a").alias("doc"), "key")
        if last or over.isEmpty():
            break
        entering = over.join(signed, "doc").select("doc", "minima", *SKETCH, "key")
    return reduce(DataFrame.unionByName, found).distinct()


def _parted(entries: DataFrame) -> DataFrame:
    """Entries of the last level: a bucket of more than LIMIT sets becomes a bucket for each two of its parts."""
    full = entries.groupBy("key").count().where(F.col("count") > LIMIT).select("key", F.ceil(F.col("count") / LIMIT).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("doc", F.lit(21)), F.col("parts")).cast("int")
    sized = entries.join(full, "key", "left").withColumn("own", own)
    small = sized.where("parts is null").select(entries.columns)
    met = sized.where("parts is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).select(entries.columns)
    return small.unionByName(met)


def _hot_keys(entering: DataFrame, level: int, runs: int, first: int) -> list[int]:
    """Keys that hold more than one in HOT_SHARE rows, by the rows of one in 16 sets; only their way is decided by it."""
    sample = entering.where(F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(16)) == 0)
    entries = sample.mapInArrow(_paths(level, runs, first), f"key bigint, doc bigint, {', '.join(f'{c} bigint' for c in SKETCH)}")
    counts = entries.groupBy("key").count().where(F.col("count") > LIMIT)
    top = counts.orderBy(F.desc("count")).limit(HOT_SHARE).collect()
    return [r.key for r in top]


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose exact similarity reaches the threshold: a, b, similarity.

    :param texts: doc, text; rows of an id repeat the same text.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    used = keep(texts.join(wanted, "doc", "left_semi").dropDuplicates(["doc"]), "texts")

    def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = word_sets(batch.column("x")), word_sets(batch.column("y"))
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], np.float64)
            whole = np.array([len(x) + len(y) for x, y in zip(left, right)], np.float64) - shared
            s = shared / np.maximum(whole, 1)
            rows = pa.array(np.flatnonzero(s >= similarity))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows), pa.array(s).take(rows)], names=["a", "b", "similarity"])

    both = pairs.join(used.select(F.col("doc").alias("a"), F.col("text").alias("x")), "a").join(used.select(F.col("doc").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(jaccard, "a bigint, b bigint, similarity double")


def near_duplicates(rows: DataFrame, doc_id: str, text: str, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Members (doc, rep) of classes of equal sets, and links (a, b, similarity) between representatives.

    ``doc_id`` is a bigint.
    """
    signed = keep(sign_texts(rows, doc_id, text), "signed")
    classes = signed.groupBy("set1", "set2").agg(F.min("doc").alias("rep"), *[F.first(c).alias(c) for c in ("minima", *SKETCH)])
    classes = keep(classes, "classes")
    members = signed.select("doc", "set1", "set2").distinct().join(classes.select("set1", "set2", "rep"), ["set1", "set2"]).select("doc", "rep")
    pairs = keep(candidate_pairs(classes.select(F.col("rep").alias("doc"), "minima", *SKETCH), similarity), "pairs")
    texts = rows.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    return members, keep(verified(pairs, texts, similarity), "links")


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of documents, classes expanded: a < b."""
    other = members.select(F.col("doc").alias("doc2"), F.col("rep").alias("rep2"))
    within = members.join(other, (F.col("rep") == F.col("rep2")) & (F.col("doc") < F.col("doc2"))).select("doc", "doc2")
    across = links.join(members.select(F.col("doc"), F.col("rep").alias("a")), "a").join(other.withColumnRenamed("rep2", "b"), "b").select("doc", "doc2")
    both = within.unionByName(across)
    return both.select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b"))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their hashes: equal as long as nothing changes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """Node and least node of its component, by alternating large and small stars.

    Each round only reads and writes pairs. The least neighbour of a node is
    aggregated before the shuffle; the edges of a node with many neighbours meet
    the one row of their node in a join that adaptive execution splits.
    """
    edges = keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = _state(edges)
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.toDF("u", "v"))
        edges = keep(small.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "edges")
        now = _state(edges)
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("least")).union(edges.select("a", "a").distinct())
        before = now


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row a document: its group (least representative), its class and the class's number of links."""
    parts = connected(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return (
        members.join(parts.select(F.col("node").alias("rep"), F.col("least").alias("group_id")), "rep", "left")
        .join(degree, "rep", "left")
        .select("doc", F.coalesce("group_id", "rep").alias("group_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
