import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import boilerplate as B


def test_suffix_array():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 3, 200)
    order, common = B.suffix_array(t, 256)
    suffixes = [tuple(t[i:]) for i in range(len(t))]
    assert order.tolist() == sorted(range(len(t)), key=lambda i: suffixes[i])
    for k in range(1, len(t)):
        a, b = suffixes[order[k - 1]], suffixes[order[k]]
        assert common[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_shared_units_against_brute_force():
    rng = random.Random(2)
    pages = [[" ".join(rng.choice("a b c".split()) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 9))] for _ in range(12)]
    got = B.shared(pages, list(range(12)), lambda tokens: 2)
    df = {line: sum(line in own for own in pages) for own in pages for line in own}
    assert {h: n for h, n in got.items() if h in {B._hash(x.split()) for x in df}} == {B._hash(x.split()): n for x, n in df.items() if n > 1}


def test_long_substrings_against_brute_force():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    legal = [rng.choice(words) for _ in range(90)]
    pages = [[" ".join([*rng.sample(words, 30), *legal[k : k + 60], *rng.sample(words, 9)]) + "."] for k in range(0, 30, 3)]
    known = np.array(sorted(B.shared(pages, list(range(10)), lambda tokens: 3)), np.uint64)
    for (line,), (share, _) in zip(pages, B.coverage(pages, [known] * 10)):
        own = B.TOKEN.findall(line)
        runs = lambda ws: {tuple(ws[i : i + B.LONG_TOKENS]) for i in range(len(ws) - B.LONG_TOKENS + 1)}
        often = [sum(r in runs(B.TOKEN.findall(p[0])) for p in pages) >= 3 for r in (tuple(own[i : i + B.LONG_TOKENS]) for i in range(len(own) - B.LONG_TOKENS + 1))]
        inside = {j for i, x in enumerate(often) if x for j in range(i, i + B.LONG_TOKENS)}
        assert abs(share[0] - len(inside) / len(own)) < 1e-9 and inside


def site(n=60):
    rng = random.Random(5)
    words = [f"wort{k}" for k in range(300)]
    rows, truth = [], set()
    for i in range(n):
        s = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."  # noqa: E731, B023
        host = "one.example" if i < 40 else f"h{i}.example"
        lines = [("We use cookies to keep the search working.", 1), ("", 0), ("[Home](/h) | [Help](/p)", 1), ("Archive > Item", 1), (f"# Title {words[i]} {words[-i]}", 0), (s(40), 0), ("## Summary", 0), (s(30), 0), ("| a | b |", 0), ("The office printed its first privacy notice.", 0), (s(30), 0), ("- " + s(14)[:-1], 0), ("## Related", 1), (f"- Note on {words[i]}", 1), (f"- Note on {words[i + 1]}", 1), (s(40), 0), ("Share this page", 1), ("© 2020 One. All rights reserved.", 1)]
        rows.append((i, f"https://WWW.{host}:443/x?{i}", "\n".join(x for x, _ in lines)))
        truth |= {(i, k) for k, (_, bad) in enumerate(lines, 1) if bad}
    return rows, truth


def test_page_outline(spark):
    rows, truth = site()
    extra = [(900, "https://a.example/", None), (901, "https://a.example/", ""), (902, "https://a.example/", " \n\t\n"), (None, "https://a.example/", "x"), (903, None, "only a label"), (904, "https://a.example/", "word " * 50_000)]
    payloads = spark.createDataFrame([(i, t, "pdf") for i, _, t in rows + extra + rows[:3]], "payload_id bigint, markdown string, host string")
    captures = spark.createDataFrame([(i, u, "x") for i, u, _ in rows + extra + rows[5:9]], "payload_id bigint, final_url string, text string")
    got = [tuple(r) for r in B.page_boilerplate(B.web_pages(payloads, captures)).collect()]
    assert len(got) == len(set(got))
    own = {g for g in got if g[0] < 900}
    assert len(own ^ truth) <= 0.03 * len(truth)
    assert not {g for g in got if g[0] in (900, 901, 902)}


def test_hosts(spark):
    urls = ["HTTPS://user@WWW.Ex.example.:8080/p?q#f", "http://ex.example", "ex.example/x", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(B.host_of(F.col("u")).alias("h"))
    assert [r.h for r in df.collect()] == ["ex.example", "ex.example", "ex.example", None]


def test_empty(spark):
    none = spark.createDataFrame([], "payload_id bigint, host string, text string")
    assert B.page_boilerplate(none).count() == 0


def test_repeated_paragraph_and_table_are_boilerplate(spark):
    """What every page of a host repeats below the title is no article, long paragraphs and tables included; a table with rows of its own is."""
    rng = random.Random(7)
    words = [f"wort{k}" for k in range(300)]
    s = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    legal, stock = s(60), "Figures are given in sheets unless stated otherwise."
    rows, truth = [], set()
    for i in range(24):
        lines = [("[Home](/h) | [Help](/p)", 1), (f"# Title {words[i]} {words[-i]}", 0), (s(45), 0), (stock, 0), ("| a | b | c |", 0), ("| --- | --- | --- |", 0), (f"| {words[i]} | {i} | {s(2)} |", 0), (s(40), 0)]
        lines += [("## Terms of use", 1), (legal, 1), ("| Day | Opens | Closes |", 1), ("| --- | --- | --- |", 1), ("| Monday | nine | five |", 1), ("| Tuesday | ten | six |", 1), ("## History", 0), (s(45), 0)]
        rows.append((i, "one.example", "\n".join(x for x, _ in lines)))
        truth |= {(i, k) for k, (_, bad) in enumerate(lines, 1) if bad}
    # copies of one page repeat nothing
    copied = "\n".join(["# Copy of a page", s(45), s(50)])
    rows += [(100 + i, "two.example", copied) for i in range(5)]
    pages = spark.createDataFrame(rows, "payload_id bigint, host string, text string")
    assert {tuple(r) for r in B.page_boilerplate(pages).collect()} == truth


def test_nothing_repeated_nothing_removed(spark, monkeypatch):
    """The suffix array decides: without what it finds no line goes."""
    rows, truth = site()
    pages = B.web_pages(spark.createDataFrame([(i, t) for i, _, t in rows], "payload_id bigint, markdown string"), spark.createDataFrame([(i, u) for i, u, _ in rows], "payload_id bigint, final_url string"))
    monkeypatch.setattr(B, "host_repeats", lambda placed: placed.select(F.col("host").alias("scope"), F.lit(1).cast("bigint").alias("hash")).limit(0))
    assert B.page_boilerplate(pages).count() == 0


def test_blocks_of_a_host_are_joined(spark, monkeypatch):
    """What a host repeats is the same in one block and in many."""
    rng = random.Random(9)
    words = [f"wort{k}" for k in range(300)]
    s = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    legal = [s(50) for _ in range(20)]
    rows = [(i, "big.example", f"# Title {words[i]} {words[-i]}\n{s(45)}\n{legal[i % 20]}\n{s(40)}") for i in range(240)]
    pages = spark.createDataFrame(rows, "payload_id bigint, host string, text string")
    monkeypatch.setattr(B, "POOL_BELOW", 0)
    one = {tuple(r) for r in B.page_boilerplate(pages).collect()}
    monkeypatch.setattr(B, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(B, "BLOCK_PAGES", 40)
    assert B._blocks(B._pages(pages)).select("block").distinct().count() > 3
    assert one == {(i, 3) for i in range(240)} == {tuple(r) for r in B.page_boilerplate(pages).collect()}


def test_what_one_page_of_a_block_has_counts(spark):
    """A unit and a long paragraph that reach the needed number only with the single pages of other blocks; one page less doesn't."""
    rng = random.Random(10)
    s = lambda k: " ".join(f"w{rng.randrange(10**9)}" for _ in range(k))
    legal, short, rare, stock, gone = s(30), "Help and contact", "Nearly often enough", "Kept by three hosts", "Kept by two hosts"
    rows = []
    for i in range(400):  # 2 % are 8 pages: 6, 1 and 1 in three blocks
        block = 0 if i < 200 else 1 if i < 300 else 2
        own = [s(5)] + ([f"{s(3)} {legal} {s(2)}", short] if i < 6 or i in (250, 350) else []) + ([rare] if i < 6 or i == 250 else [])
        rows.append((f"host big {block}", i, "big", "\n".join(own), 400, False, 3, 2, 40))
    for i in range(40):
        own = [s(5)] + ([stock] if i in (3, 4, 30) else []) + ([gone] if i in (3, 30) else [])
        rows.append((f"pool {i // 20}", 1000 + i, f"h{i}", "\n".join(own), 1, True, 1, 2, 40))
    placed = spark.createDataFrame(rows, "block string, payload_id bigint, host string, text string, texts bigint, small boolean, cuts int, pools int, pool_hosts bigint")
    got = {(r.scope, r.hash % 2**64) for r in B.host_repeats(placed).collect()}
    named = lambda text: B._hash(text.split())
    assert {x for x in got if x[1] in {named(short), named(rare), named(stock), named(gone)}} == {("big", named(short)), (B.ALL_POOLS, named(stock))}
    windows = B.Stream([[legal]]).window_hashes()[1:12]
    assert {("big", int(w)) for w in windows} <= got
    lines = {r.payload_id: r.share for r in B.line_repeats(placed, B.host_repeats(placed)).collect()}
    assert lines[250][2] == 1 and lines[250][1] > 0.8 and lines[250][3] == 0 and lines[1030][1:] == [1.0, 0.0]


def test_blocks_and_pools_repeat_what_one_stream_repeats(spark, monkeypatch):
    """Around the needed number, any cut into blocks finds what a single block finds."""
    rng = random.Random(11)
    rows = [(i, f"h{i % 150}.example" if i % 2 else "big.example", [f"own{i}", *(f"item{k}" for k in range(60) if rng.random() < k / 1200)]) for i in range(600)]
    pages = spark.createDataFrame([(i, h, "\n".join(own)) for i, h, own in rows], "payload_id bigint, host string, text string")
    monkeypatch.setattr(B, "POOL_BELOW", 3000)
    repeats = lambda scope: {r.hash for r in B.host_repeats(B._blocks(B._pages(pages))).collect() if r.scope == scope}
    one, pool = repeats("big.example"), repeats("pool 0")
    assert 10 < len(one) < 50 and len(pool) > 10
    monkeypatch.setattr(B, "BLOCK_BYTES", 900)
    monkeypatch.setattr(B, "BLOCK_PAGES", 30)
    blocks = {r.block for r in B._blocks(B._pages(pages)).collect()}
    assert len(blocks) > 6
    assert repeats("big.example") == one and repeats(B.ALL_POOLS) == pool


def test_articles(spark):
    rows, truth = site()
    pages = spark.createDataFrame([(i, B.re.sub(r"^https://WWW[.]|:.*", "", u), t) for i, u, t in rows], "payload_id bigint, host string, text string")
    bad = {tuple(r) for r in B.page_boilerplate(pages).collect()}
    texts = {i: t.split("\n") for i, _, t in rows}
    for r in B.page_articles(pages).collect():
        assert [x for x in r.article.split("\n") if x] == [x for k, x in enumerate(texts[r.payload_id], 1) if x and (r.payload_id, k) not in bad]
