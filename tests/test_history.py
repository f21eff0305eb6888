import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillspark.operators import history

FACTS = "entity string, payload string, at_us bigint, rank int, extra string"


def brute(facts):
    out = set()
    by = {}
    for e, p, t, r, *_ in facts:
        if e is not None and p is not None and t is not None:
            by.setdefault(e, {})
            by[e][t] = max(by[e].get(t, (-1, "")), (r, p))
    for e, at in by.items():
        runs = []
        for t in sorted(at):
            if not runs or runs[-1][0] != at[t][1]:
                runs.append((at[t][1], t))
        for k, (p, t) in enumerate(runs):
            out.add((e, p, t, runs[k + 1][1] if k + 1 < len(runs) else None))
    return out


def found(spark, facts, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = history.validity_periods(spark.createDataFrame(facts, FACTS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_hot_entity_over_many_blocks(spark):
    rng = random.Random(1)
    facts = [("hot" if rng.random() < 0.5 else f"e{rng.randrange(20)}", rng.choice("aab"), rng.randrange(400), rng.randrange(3), "x") for _ in range(1500)]
    assert found(spark, facts, 13) == brute(facts)


def test_one_long_run_over_all_blocks(spark):
    facts = [("e", "a", t, 1, None) for t in range(300)] + [("e", "b", 1000, 1, None)]
    assert found(spark, facts, 7) == {("e", "a", 0, 1000), ("e", "b", 1000, None)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 12)), st.integers(0, 2), st.just("z")), max_size=60))
def test_any_facts(spark, facts):
    assert found(spark, facts, 5) == brute(facts)


def test_ledger(spark):
    versions = spark.createDataFrame([("src_A ", "H1", "2024-01-01T00:00:00Z"), ("src_a", "h1\t", "2024-01-01T02:00:00+03:00"), ("src_a", "h1", None), ("src_b", "h9", "bad"), (None, "h1", "2024-01-01T00:00:00Z")], "source_id string, sha256 string, first_seen_at string")
    events = spark.createDataFrame(
        [(1, "src_a", "h1", "h2", "2024-02-01 00:00:00+00:00", 1), (1, "src_a", "h1", "h3", "2024-02-02T00:00:00Z", 2), (2, "SRC_A", "h0", "h3", "2024-03-01T00:00:00Z", 1), (3, None, None, None, None, None)],
        "event_id bigint, source_id string, prior_sha256 string, adopted_sha256 string, recorded_at string, delivered_at bigint",
    )
    records = spark.createDataFrame([("src_a", "2023-12-01T00:00:00Z"), ("src_a", "2023-11-01T00:00:00.5Z")], "source_id string, created_at string")
    day = 86_400_000_000
    got = {(r.source_id, r.sha256, r.valid_from_us, r.valid_to_us) for r in history.content_history(versions, events, records).collect()}
    t0, t1, t2 = 1_698_796_800_500_000, 1_704_063_600_000_000, 1_706_745_600_000_000 + day
    assert got == {("src_a", "h0", t0, t1), ("src_a", "h1", t1, t2), ("src_a", "h3", t2, -1)}


def test_empty(spark):
    assert history.validity_periods(spark.createDataFrame([], FACTS)).count() == 0
