import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import mix

ROWS, TARGETS = "id bigint, source string, size bigint, given double", "source string, target_share double, max_repeats int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10_000), st.floats(0, 1), st.integers(0, 8)), max_size=12), st.floats(0, 50_000))
def test_water_fill(rows, total):
    sizes, shares, repeats = ([r[k] for r in rows] for k in range(3))
    given_ = mix.water_fill(sizes, shares, repeats, total)
    caps = [n * r if w > 0 else 0 for n, w, r in rows]
    assert all(-1e-6 <= g <= c * (1 + 1e-9) + 1e-6 for g, c in zip(given_, caps))
    assert sum(given_) == pytest.approx(min(total, sum(caps)), rel=1e-6, abs=1e-3)
    free = [g / w for g, c, w in zip(given_, caps, shares) if w > 1e-6 and g < c * (1 - 1e-9) and g > 0]
    assert not free or max(free) == pytest.approx(min(free), rel=1e-6)


def test_shares_and_caps(spark):
    rows = [(k, "Big_One " if k % 2 else "big-one", 10 + k % 7, None) for k in range(3000)] + [(9000 + k, "small", 5, None) for k in range(10)] + [(1, None, 5, None), (2, "other", 5, None), (3, "small", 0, None), (4, "small", None, None), (None, "small", 5, None)]
    targets = [("big-one", 0.5, 3), ("SMALL", 0.3, 4), ("nothing", 0.2, 2), ("twice", None, None), (None, 0.1, 1)]
    mixture, report = mix.mix_sources(spark.createDataFrame(rows, ROWS), spark.createDataFrame(targets, TARGETS), total=60_000.0, seed=5)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big-one", "small", "nothing", "twice"}
    assert got["small"].actual == 11 * 5 * 4 and got["small"].clamped and got["small"].most_copies == 4
    assert got["nothing"].actual == 0 and got["nothing"].actual_share == 0
    assert abs(got["big-one"].actual - (60_000 - 220)) <= 10 and got["big-one"].most_copies == 2
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)
    copies = mixture.collect()
    assert sum(r.size * r.copies for r in copies) == sum(r.actual for r in got.values())
    again = mix.mix_sources(spark.createDataFrame(rows, ROWS).repartition(5), spark.createDataFrame(targets, TARGETS), total=60_000.0, seed=5)[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, copies))


def test_empty(spark):
    none = spark.createDataFrame([], ROWS)
    mixture, report = mix.mix_sources(none, spark.createDataFrame([("a", 1.0, 2)], TARGETS))
    assert mixture.count() == 0 and report.first().actual == 0
    assert mix.mix_sources(spark.createDataFrame([(1, "a", 5, None)], ROWS), spark.createDataFrame([], TARGETS))[0].count() == 0
