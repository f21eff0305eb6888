import random

import numpy as np
import pyarrow as pa
import regex

from quillspark.llm import neardup as N

SCHEMA = "payload_id bigint, markdown string, doc string, rep bigint, text string"


def brute(texts, least):
    sets = {}
    for i, t in texts.items():
        w = regex.findall(r"[\p{L}\p{Nd}]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def corpus(seed=6):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts, k = {}, 0
    for _ in range(150):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 150))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                cut = rng.randrange(len(own))
                own = own[cut:] + own[:cut]
            texts[k] = " ".join(own)
            k += 1
    hot = " ".join(words[:50])
    texts |= {k + j: hot.upper() if j % 2 else hot + "!" for j in range(60)}
    return texts | {9000: None, 9001: "", 9002: "one two three four", 9003: "one two three four", 9004: "ÄÖ ü1 b c d e f", 9005: "äö Ü1 b c d e f"}


def test_finds_all_pairs(spark, monkeypatch):
    texts = corpus()
    rows = [(i, t, "x", 1, None) for i, t in texts.items()] + [(3, texts[3], "again", None, None), (None, texts[3], None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    members, links = N.near_duplicates(df, "payload_id", "markdown", 0.5)
    got = [tuple(r) for r in N.similar_pairs(members, links).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(texts, 0.5)
    # one row a document, components as those of the pairs
    parent = {i: i for i in {r.doc for r in members.collect()}}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    table = {r.doc: r for r in N.groups(members, links).collect()}
    assert set(table) == set(parent)
    assert {frozenset(i for i in table if table[i].group_id == g) for g in {r.group_id for r in table.values()}} == {frozenset(i for i in parent if top(i) == g) for g in set(map(top, parent))}


def test_full_buckets_are_split(spark, monkeypatch):
    texts = {i: t for i, t in corpus(7).items() if t}
    signed = N.keep(N.sign_texts(spark.createDataFrame(list(texts.items()), "id bigint, text string"), "id", "text"), "t")
    sets = signed.dropDuplicates(["set1", "set2"]).select("doc", "minima", *N.SKETCH)
    whole = {tuple(r) for r in N.candidate_pairs(sets, 0.5).collect()}
    monkeypatch.setattr(N, "first_depth", lambda best, total: 1)
    monkeypatch.setattr(N, "LIMIT", 3)
    split = {tuple(r) for r in N.candidate_pairs(sets, 0.5).collect()}
    reps = {r.doc for r in sets.collect()}
    want = {(a, b) for a, b in brute(texts, 0.6) if a in reps and b in reps}
    assert want <= whole and len(want - split) <= 0.02 * len(want)


def test_sets_and_sketches():
    sets = N.word_sets(pa.array(["a b c d e f", "", "x", None if False else "a b c d e", "!!a, b; C d\ne."]))
    assert [len(s) for s in sets] == [2, 0, 0, 1, 1] and sets[3][0] == sets[4][0] and sets[3][0] in sets[0]
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 60, 1000, dtype=np.uint64)
    s = N.sketch(np.stack([N.minima(x[:600]), N.minima(x[200:800]), N.minima(x[:600])]))
    rows = [s[:, c] for c in range(4)]
    agree = N.agreeing([c[[0, 0]] for c in rows], [c[[1, 2]] for c in rows])
    assert agree[1] == 64 and abs(agree[0] / 64 - (0.5 + 0.5 / 16)) < 0.2
    assert N.runs_needed(0.8, 2) < N.runs_needed(0.5, 2) < N.runs_needed(0.5, 3)


def test_empty(spark):
    members, links = N.near_duplicates(spark.createDataFrame([], SCHEMA), "payload_id", "markdown", 0.5)
    assert N.similar_pairs(members, links).count() == 0 and N.groups(members, links).count() == 0


def test_recall_at_every_depth():
    """Planted pairs at a similarity of 0.55, all of whose buckets are split on every level."""
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 310, dtype=np.uint64)
        pairs.append((N.minima(x[:240]), N.minima(x[70:])))  # 170 of 310 are shared
    same = np.array([a == b for a, b in pairs])
    for first in range(1, 6):
        runs = N.runs_needed(0.5, first)
        orders = N._orders(runs, first)
        assert all(len(set(o)) == N.WIDTH for o in orders.tolist())
        kept = same[:, orders[:, :first]].all(2)
        for level in range(1, N.DEPTH):
            at = first + N.BRANCHES * (level - 1)
            kept &= same[:, orders[:, at : at + N.BRANCHES]].any(2)
        assert kept.any(1).mean() >= 0.98, (first, runs)
        assert runs == N.RUNS_MOST or N.recall(0.5, first, runs) >= N.RECALL


def test_full_buckets_of_the_last_level_are_cut(spark, monkeypatch):
    texts = {i: t for i, t in corpus(9).items() if t}
    signed = N.keep(N.sign_texts(spark.createDataFrame(list(texts.items()), "id bigint, text string"), "id", "text"), "t")
    sets = signed.dropDuplicates(["set1", "set2"]).select("doc", "minima", *N.SKETCH)
    monkeypatch.setattr(N, "first_depth", lambda best, total: 1)
    monkeypatch.setattr(N, "DEPTH", 1)
    whole = {tuple(r) for r in N.candidate_pairs(sets, 0.5).collect()}
    monkeypatch.setattr(N, "LIMIT", 2)
    assert {tuple(r) for r in N.candidate_pairs(sets, 0.5).collect()} == whole
