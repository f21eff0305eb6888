import random

from quillspark.operators.references import orphan_references, orphan_report

REFS, PARENTS, LOG = "ref_id bigint, ref_field string, key string, at_us bigint", "ref_field string, key string, since_us bigint", "ref_field string, key string, at_us bigint, n bigint, removed boolean"


def brute(refs, parents, log):
    out = set()
    for i, f, k, t in refs:
        if k is None:
            continue
        since = [s for g, x, s in parents if g == f and x == k]
        entries = [(a, n, r) for g, x, a, n, r in log if g == f and x == k]
        before = sorted((a, n, r) for a, n, r in entries if a is not None and t is not None and a <= t)
        known = [s for s in since if s is not None]
        if before and before[-1][2]:
            out.add((i, f, "deleted"))
        elif not since and not entries:
            out.add((i, f, "missing"))
        elif since and t is not None and (min(known) > t if known else True):
            out.add((i, f, "late"))
    return out


def run(spark, refs, parents, log, **options):
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(log, LOG), **options).collect()
    assert len(got) == len({(r.ref_id, r.ref_field, r.miss_kind) for r in got})
    return {(r.ref_id, r.ref_field, r.miss_kind) for r in got}


def test_against_brute_force_with_hot_key(spark):
    rng = random.Random(2)
    keys = [f"k{i}" for i in range(40)]
    refs = [(i, rng.choice("ab"), "k0" if rng.random() < 0.4 else rng.choice(keys + [None, ""]), rng.randrange(100)) for i in range(2000)]
    refs += refs[:100]
    parents = [(f, k, rng.randrange(80)) for f in "ab" for k in keys if rng.random() < 0.7] * 2
    log = [(rng.choice("ab"), rng.choice(keys + ["gone"]), rng.randrange(100), n, rng.random() < 0.6) for n in range(80)]
    assert run(spark, refs, parents, log, batch_rows=50) == brute(refs, parents, log)


def test_nulls_and_empty_tables(spark):
    refs = [(1, "a", "x", None), (2, "a", None, 5), (3, "a", "", 5), (4, "a", "y", 5)]
    assert run(spark, refs, [], []) == {(1, "a", "missing"), (3, "a", "missing"), (4, "a", "missing")}
    assert run(spark, [], [("a", "x", 1)], []) == set()
    log = [("a", "y", 5, 1, True), ("a", "y", 5, 2, False), (None, None, None, None, None)]
    assert run(spark, refs, [("a", "x", 1), ("a", None, 1)], [x for x in log if x[0]]) == {(3, "a", "missing")}


def test_report(spark):
    rows = [(1, "source_id", 0, "missing"), (1, "content_sha256", 0, "late"), (2, "source_id", 0, "missing")]
    got = orphan_report(spark.createDataFrame(rows, "ref_id bigint, ref_field string, at_us bigint, miss_kind string")).collect()
    assert {tuple(r) for r in got} == {("source_records", "1970-01", "missing", 2, 2), ("content_versions", "1970-01", "late", 1, 1)}
