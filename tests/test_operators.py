import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import hashing, markdown, strings
from quillspark.operators import citations, evidence, events, extraction, graph, ordering, publish, reconcile, search
from quillspark.sources import files, ledger
from quillspark.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_request_is_validated():
    for bad in ({"terms": ()}, {"terms": ("a", "a")}, {"terms": (" ",)}, {"terms": ("a\n",)}, {"terms": ("a",), "context": 21}, {"terms": ("a",), "page_size": 0}, {"terms": ("a",), "scope": "x"}):
        with pytest.raises(ValueError):
            search.SearchRequest(**bad)


def test_search_and_proof(spark):
    docs = spark.createDataFrame([(1, "a\nfoo\nb\nc\n"), (2, None), (3, ""), (4, "bar"), (5, "x\nfoo bar\n\nfoo")], "id bigint, text string")
    assert {(r.doc, r.line_no) for r in search.matching_lines(docs, "id", "text", ("foo", "bar")).collect()} == {(1, 2), (4, 1), (5, 2), (5, 4)}
    got = {(r.doc, r.line_no, r.kind) for r in search.lines_with_context(docs, "id", "text", ("foo",), 1).collect()}
    assert got == {(1, 1, "context"), (1, 2, "match"), (1, 3, "context"), (5, 1, "context"), (5, 2, "match"), (5, 3, "context"), (5, 4, "match")}
    pages = search.search_pages(docs, "id", "text", search.SearchRequest(("foo",), page_size=2))
    assert sorted((r.ordinal, r.page) for r in pages.collect()) == [(1, 0), (2, 0), (3, 1)]
    proof = search.run_summary(pages)
    assert proof.first().asDict() | {"digest": ""} == {"n_pages": 2, "n_matches": 3, "complete": True, "digest": ""}
    assert search.verify_run(pages, proof).first().verified
    assert not search.verify_run(pages.where("ordinal < 3"), proof).first().verified
    none = search.search_pages(docs, "id", "text", search.SearchRequest(("nothing",)))
    assert search.run_summary(none).select("n_pages", "n_matches", "complete").first() == (1, 0, True)
    with pytest.raises(ValueError):
        search.restricted(docs, "id", spark.createDataFrame([(99,)], "id bigint"))


def test_identities(spark):
    sha = hashlib.sha256(b"x").hexdigest()
    assert one(spark, hashing.source_id(F.col("p"), F.col("s")), p="a/b", s=sha) == "src_" + hashlib.sha256(f"source-v1\0a/b\0{sha}".encode()).hexdigest()
    rows = spark.createDataFrame([("b", "1", None), ("a", None, "d")], "source_id string, active_content_sha256 string, active_derivation_id string")
    assert hashing.corpus_revision(rows).first() == (hashlib.sha256(b"a\0\0d\nb\x001\0").hexdigest(), 2)
    assert one(spark, hashing.split_version(F.col("v")), v="1.0+x+abc") == ("1.0+x", "abc")


def test_strings(spark):
    assert one(spark, strings.canonical_url(F.col("u")), u="HTTP://ExA.mple:80?q=1#f") == "http://exa.mple/?q=1"
    assert one(spark, strings.canonical_url(F.col("u")), u="ftp://x") is None
    urls = {"https://a.example": "https://a.example/", "http://a.b:8080?x": "http://a.b:8080/?x", "https://u:p@a.b/": None, "http://a b/": None, "http://a.b:/": None, "http://a.b:70000/": None, "http://-a.b/": None, "http://a%41.b/": None, "http://[2001:DB8::1]:443/x": "http://[2001:db8::1]:443/x", "https://B\u00fccher.example/\u00e4": "https://xn--bcher-kva.example/\u00e4", "http://127.0.0.1/?#f": "http://127.0.0.1/"}
    assert {u: one(spark, strings.canonical_url(F.col("u")), u=u) for u in urls} == urls
    for bad in ("a%2fb.md", "a%2Fb.md", "./a.md", "x/../a.md", "http://a", "a?b", "a\\b", "%7Ea.md", "../x/a.md", "a//b.md", "%c3%a4.md", ""):
        assert one(spark, strings.resolve_link(F.col("t"), F.col("b")), t=bad, b="x/y.md") is None, bad
    assert one(spark, strings.resolve_link(F.col("t"), F.col("b")), t="%C3%A4.md", b="x/y.md") == "x/\u00e4.md"
    assert one(spark, strings.safe_filename(F.col("n"), F.lit("image/png")), n=".a / b-") == "a-b.png" and one(spark, strings.safe_filename(F.col("n")), n="//") == "snapshot.bin"
    assert one(spark, strings.relative_link(F.col("t"), F.col("b")), t="a/b c.md", b="x/y.md") == "../a/b%20c.md"
    assert one(spark, strings.resolve_link(F.col("t"), F.col("b")), t="../a/b%20c.md#s", b="x/y.md") == "a/b c.md"
    assert one(spark, strings.resolve_link(F.col("t"), F.col("b")), t="../../a", b="x/y.md") is None
    assert one(spark, strings.canonical_json(F.col("j")), j='{"b": 1, "a": [true]}') == '{"a":[true],"b":1}\n'
    assert one(spark, strings.canonical_json(F.col("j")), j='{"a":1,"a":2}') is None
    assert one(spark, strings.canonical_json(F.col("j")), j="[NaN]") is None
    assert one(spark, strings.strict_utc(F.col("t")), t="2024-01-01 00:00:00Z") is None
    assert one(spark, strings.suffix(F.col("p")), p="a/.hidden") == "" and one(spark, strings.suffix(F.col("p")), p="a/b.TXT") == ".txt"
    assert one(spark, strings.is_relative_posix(F.col("p")), p="a/../b") is False
    assert one(spark, F.col("t").rlike(strings.whole_token("a.b")), t="xa.b a.b!") and not one(spark, F.col("t").rlike(strings.whole_token("a.b")), t="xa.b aXb é_a.b_")
    assert one(spark, strings.idna_host(F.col("h")), h="bücher.example") == "xn--bcher-kva.example"


def test_markdown(spark):
    text = "---\nid: p1\ntitle: \"T: x\"\naliases: [A, 'B c']\n---\n# One\n\n```\n# no [^c]\n```\n### Three [^a] `[^b]`\n## Two\n[^a]: source_id: src_1; content_sha256: h; derivation_id: d; anchor: line:1\n- [L](../p.md): note"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id bigint, text string")
    heads = markdown.headings(docs, "id", "text")
    assert [(r.line_no, r.level, r.title) for r in heads.orderBy("line_no").collect()] == [(6, 1, "One"), (11, 3, "Three [^a] `[^b]`"), (12, 2, "Two")]
    assert {(r.line_no, r.end_line) for r in markdown.section_extents(heads).collect()} == {(6, None), (11, 11), (12, None)}
    assert [r.line_no for r in markdown.skipped_levels(heads).collect()] == [11]
    assert {(r.line_no, r.citation_id) for r in markdown.markers(docs, "id", "text").collect()} == {(11, "a")}
    defs = citations.parse_definition(markdown.definitions(docs, "id", "text")).first()
    assert (defs.citation_id, defs.source_id, defs.anchor, defs.complete) == ("a", "src_1", "line:1", True)
    assert markdown.relations(docs, "id", "text").first()[2:] == ("L", "../p.md", "note")
    f = markdown.frontmatter(F.col("text"))
    row = docs.where("id = 1").select(f.alias("f"), markdown.inline_list(F.element_at(f, "aliases")).alias("a")).first()
    assert row.f["title"] == "T: x" and row.a == ["A", "B c"]
    assert docs.where("id = 3").select(markdown.frontmatter(F.col("text")).alias("f")).first().f is None


def test_reconcile(spark):
    live = spark.createDataFrame([("same", 1, 1, "h1", None), ("edited", 2, 2, "new", None), ("moved", 1, 1, "h3", None), ("new", 1, 1, "h9", None), ("x1", 1, 1, "dup", None), ("x2", 1, 1, "dup", None), ("l.url.md", 1, 1, None, "u2"), ("same", 1, 1, "h1", None)], ingest.LIVE)
    known = spark.createDataFrame([("s1", "same", 1, 1, "h1", None), ("s2", "edited", 2, 1, "old", None), ("s3", "was", 1, 1, "h3", None), ("s4", "gone", 1, 1, "h4", None), ("s5", "o", 1, 1, "dup", None), ("s6", "l.url.md", 1, 1, None, "u1"), ("s7", "dir/f", 1, 1, "h7", None)], "source_id string, " + ingest.LIVE)
    got = {(r.path, r.source_id, r.action) for r in reconcile.reconcile(live, known, spark.createDataFrame([("dir",)], "path string")).collect()}
    assert got == {("same", "s1", "retain"), ("edited", "s2", "integrity_error"), ("moved", "s3", "rename"), ("new", None, "create"), ("gone", "s4", "missing"), ("x1", None, "ambiguous"), ("x2", None, "ambiguous"), ("o", "s5", "ambiguous"), ("l.url.md", "s6", "process"), ("dir/f", "s7", "obscured")}
    again = reconcile.reconcile(known.drop("source_id"), known)
    assert {r.action for r in again.collect()} == {"retain"}
    counts = {r.action: r.n for r in reconcile.zero_filled(again, "action", reconcile.ACTIONS).collect()}
    assert counts["retain"] == 7 and counts["create"] == 0
    state = spark.createDataFrame([("ok", "integrity_error", None, False), ("ok", "integrity_error", "ok", True), ("extracting", "retain", None, None), ("awaiting_approval", "missing", None, None), ("ok", "create", "failed", None)], "state string, action string, outcome string, adopted boolean")
    assert [r.x for r in state.select(reconcile.next_state(*[F.col(c) for c in state.columns]).alias("x")).collect()] == ["integrity_error", "ok", "pending", "awaiting_approval", "failed"]


def test_extraction(spark):
    assert one(spark, extraction.text_payload(F.col("t")), t="a\r\nb\n") == '<a id="line:1"></a>\n<a id="line:2"></a>\n\na\nb\n'
    assert one(spark, extraction.html_text(F.col("h")), h="<script>x</script><h2>T &lt;</h2><p>a<br>b</p><ul><li>c</ul>") == "## T &lt;\n\na\nb\n\n- c"
    assert one(spark, extraction.parse_delimited(F.col("t")), t='a,"b\nc"\nd') == [["a", "b\nc"], ["d"]]
    assert one(spark, extraction.json_payload(F.col("t")), t='{"b":"```","a":1}').startswith('<a id="block:1"></a>\n\n````json\n{\n  "a": 1')
    assert one(spark, extraction.json_payload(F.col("t")), t="nope") is None
    assert one(spark, extraction.form_feed_pages(F.col("t")), t="a\fb\f") == ["a", "b"]
    assert one(spark, extraction.sections(F.col("t")), t="x\n# a\ny\n## b") == ["x", "# a\ny", "## b"]
    assert one(spark, extraction.sniff_media_type(F.col("c"), F.col("p")), c=b"%PDF-1.4", p="a.txt") == "application/pdf"
    assert one(spark, extraction.sniff_media_type(F.col("c"), F.col("p")), c=b"\xff\xfe", p="a.txt") == "application/octet-stream"
    rows = spark.createDataFrame([([["a|b", None], ["<c>"]],)], "rows array<array<string>>")
    assert rows.select(extraction.table_payload(F.col("rows")).alias("x")).first().x.split("\n") == ["| Column 1 | Column 2 | Source row |", "| --- | --- | --- |", '| a\\|b |  | <a id="row:1"></a> |', '| &lt;c&gt; |  | <a id="row:2"></a> |', ""]
    assert spark.createDataFrame([([[" ", None]],)], "rows array<array<string>>").select(extraction.table_payload(F.col("rows")).alias("x")).first().x is None
    assert one(spark, extraction.text_payload(F.col("t")), t='x<a id="line:3"></a>y<a id="foo:3">') == '<a id="line:1"></a>\n\nx&lt;a id="line:3"&gt;&lt;/a&gt;y<a id="foo:3">'
    assert one(spark, extraction.html_text(F.col("h")), h="<svg><p>x</svg>a<math>b</math><canvas>c</canvas><tr><td>d</td><th>e</th></tr>") == "ac\n\n d e"
    assert one(spark, extraction.json_payload(F.col("t"), lines=True), t='1\n\n[2]') == '<a id="block:1"></a>\n\n```json\n1\n```\n\n<a id="block:2"></a>\n\n```json\n[\n  2\n]\n```\n'
    assert one(spark, extraction.needs_rendering(F.col("h")), h="<head>x</head><script>y</script> ") and not one(spark, extraction.needs_rendering(F.col("h")), h="<script>y</script>z")
    assert one(spark, extraction.numbered_payload(F.split("t", ","), "page"), t=" a,b\n") == '<a id="page:1"></a>\n\na\n\n<a id="page:2"></a>\n\nb\n'
    states = spark.createDataFrame([("empty_extraction", "text", True), ("low_confidence_ocr", "image", True), ("low_confidence_ocr", "pdf", True), ("converter_timeout", "image", False), (None, "pdf", True)], "code string, extractor string, agent boolean")
    assert [r.x for r in states.select(extraction.outcome_state(*[F.col(c) for c in states.columns]).alias("x")).collect()] == ["needs_agent", "needs_agent", "failed", "failed", "ok"]


def test_graph_and_citations(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "c"), ("a", "z")], "a string, b string")
    kinds = spark.createDataFrame([("a", "page"), ("b", "page"), ("c", "question")], "doc string, kind string")
    assert {tuple(r) for r in graph.relation_problems(edges, kinds, "page").collect()} == {("c", "c", "relationship_self"), ("a", "c", "relationship_target_kind_invalid"), ("a", "z", "relationship_target_missing"), ("a", "c", "relationship_not_reciprocal"), ("a", "z", "relationship_not_reciprocal")}
    lines = spark.createDataFrame([(1, 1, "see [old map](x.md) and map"), (1, 2, "map")], "doc bigint, line_no bigint, line string")
    first = graph.first_mentions(lines, ("map", "old map"))
    assert first.first() == (1, 1, 6, "old map")
    assert graph.unlinked_mentions(first, graph.label_spans(lines)).count() == 0
    cites = spark.createDataFrame([(1, "s", "h", "d", "line", "1"), (1, "S ", "h", "d", "line", "1"), (2, "s", "h", "d", "line", "2"), (3, None, "h", "d", "line", "1"), (4, "x", "h", "d", "line", "1")], "citation_key bigint, source_id string, content_sha256 string, derivation_id string, anchor_kind string, anchor_value string")
    records, versions = spark.createDataFrame([("s",)], "source_id string"), spark.createDataFrame([("s", "h")], "source_id string, sha256 string")
    payloads = spark.createDataFrame([("d", "s", "h", [("line", "1")])], "derivation_id string, source_id string, content_sha256 string, anchors array<struct<kind:string,value:string>>")
    assert {tuple(r) for r in citations.citation_integrity(cites, records, versions, payloads).collect()} == {(2, "citation_anchor_missing"), (3, "citation_definition_invalid"), (4, "citation_source_missing")}


def test_evidence_events_publish(spark):
    runs = spark.createDataFrame([(p, p, "r", True) for p in search.PASSES], "search_pass string, run_id string, revision string, complete boolean")
    rows = spark.createDataFrame([("discovery", 1), ("expansion", 1), ("other", 2)], "run_id string, doc bigint")
    assert evidence.packet(runs, rows).first() == (True, "r", 1)
    assert evidence.packet(runs.where("run_id <> 'expansion'"), rows).first().valid is False
    seq = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5)], "g string, n bigint")
    assert [tuple(r) for r in events.sequence_gaps(seq, ["g"], "n").collect()] == [("a", 2, 5)]
    assert [tuple(r) for r in events.sequence_gaps(seq.where("n > 4"), ["g"], "n").collect()] == [("a", 0, 5)]
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, text string")
    manifest = spark.createDataFrame([("a", "write", hashlib.sha256(b"9").hexdigest()), ("b", "delete", None)], "path string, operation string, sha256 string")
    staged = spark.createDataFrame([("a", "9")], "path string, text string")
    assert publish.staged_problems(manifest, staged).count() == 0
    after = publish.apply_changes(before, manifest, staged)
    assert {(r.path, r.change) for r in publish.difference(before, after, "path", "text").collect()} == {("a", "changed"), ("b", "removed")}
    assert publish.same_set(before, before) and not publish.same_set(before, after)


def test_ordering(spark):
    rows = spark.createDataFrame([(k, 10_000 if k == 1 else 30_000 if k == 2 else 5) for k in range(1, 301)], "k bigint, s bigint")
    assert [r.ordinal for r in ordering.number_rows(rows.repartition(7), ["k"]).orderBy("k").collect()] == list(range(1, 301))
    got = ordering.bounded_sample(rows, ["k"], F.col("s"), 4, 32 << 10).collect()
    assert sorted(r.k for r in got) == [1, 3, 4] and got[0].total == 300


def test_files_and_stream(spark, tmp_path):
    root = tmp_path / "raw"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a.txt").write_text("hello")
    (root / ".DS_Store").write_text("x")
    (root / "b.url.md").write_text("---\nkind: url\nurl: http://x/\ndescription: d\nadded: 2024-01-02\n---\n")
    rows = {r.path: r for r in files.scan_tree(spark, str(root)).collect()}
    assert set(rows) == {"sub/a.txt", "b.url.md"} and rows["sub/a.txt"].sha256 == hashlib.sha256(b"hello").hexdigest() and rows["b.url.md"].url == "http://x/"
    ledger.publish(spark.range(3), str(tmp_path / "t")) if (tmp_path / "t").mkdir() is None else None
    ledger.publish(spark.range(5), str(tmp_path / "t"))
    assert ledger.published(spark, str(tmp_path / "t")).count() == 5
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"path":"p","byte_size":1,"mtime_ns":1,"sha256":"h"}\n')
    known = spark.createDataFrame([], "source_id string, " + ingest.LIVE)
    q = ingest.reconcile_stream(ingest.stream_inventory(spark, str(tmp_path / "in")), known, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r.action for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["create"]
    (tmp_path / "shards").mkdir()
    (tmp_path / "shards" / "src_1.json").write_text('{"source_id":"src_1","state":"ok","versions":{"h":{"sha256":"h","raw_path":"p","byte_size":1}},"active_content_sha256":"h","active_derivation_id":"d"}')
    records = ledger.read_records(spark, str(tmp_path / "shards"))
    assert ledger.versions(records).first().raw_path == "p" and ledger.unheld_pointers(records).first().code == "active_derivation_missing"


def test_page_reciprocity_takes_every_relation(spark, tmp_path):
    from quillspark.plans.corpus_queries import QUERIES

    page = lambda name, *to: f"---\naliases: [{name}]\n---\n\n# {name}\n\n" + "\n".join(f"- [{t}](../pages/{t.lower()}.md): note\u2028" for t in to)
    pages = {f"P{k}": [f"P{(k + 1) % 40}", *([f"P{(k - 1) % 40}"] if k % 2 else [])] for k in range(40)}
    spark.createDataFrame([(k, page(n, *to)) for k, (n, to) in enumerate(pages.items())], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    edges = {(a, b) for a, to in pages.items() for b in to}
    path = lambda n: f"wiki/pages/{n.lower()}.md"
    got = [tuple(r) for r in QUERIES["page_reciprocity"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((path(a), path(b)) for a, b in edges if (b, a) not in edges)
    assert 0 < len(got) < len(edges)


def test_skips_gaps_and_chains(spark):
    live = spark.createDataFrame([("a/new", 1, 1, "s9", None)], "path string, byte_size bigint, mtime_ns bigint, sha256 string, url string")
    records = spark.createDataFrame([("s1", "a/x", 1, 1, "s1", None), ("s2", "b/y", 1, 1, "s2", None)], "source_id string, path string, byte_size bigint, mtime_ns bigint, sha256 string, url string")
    skip = lambda p: spark.createDataFrame([(p,)], "path string")
    actions = lambda s: {r.source_id: r.action for r in reconcile.reconcile(live, records, s).collect()}
    assert actions(skip("a")) == {None: "create", "s1": "obscured", "s2": "missing"}
    assert actions(skip(None)) == {None: "create", "s1": "obscured", "s2": "obscured"}
    states = spark.createDataFrame([("s1", "failed", "p1", ["x", "y"]), ("s2", "warning", "p2", None), ("s3", "ok", "p3", ["z"]), ("s4", "extracting", "p4", None)], "source_id string, state string, path string, codes array<string>")
    skipped = spark.createDataFrame([("q", "unreadable")], "path string, code string")
    assert {tuple(r) for r in reconcile.coverage_gaps(states, skipped).collect()} == {(None, "unreadable", "q"), ("s1", "x", "p1"), ("s1", "y", "p1"), ("s2", "source_warning", "p2")}
    events_ = spark.createDataFrame([("a", 1, "1", "2", 10), ("a", 2, "2", "3", 20), ("b", 3, "1", "2", 10), ("b", 4, "1", "3", 20), ("c", 5, "1", "2", 10), ("c", 6, "2", "1", 20), ("d", 7, "9", "2", 10)], "source_id string, event_id bigint, prior_sha256 string, adopted_sha256 string, at_us bigint")
    held = spark.createDataFrame([("a", "1", 5), ("a", "2", 10), ("a", "3", 20), ("b", "1", 5), ("b", "2", 10), ("b", "3", 20), ("c", "1", 5), ("c", "2", 11), ("d", "2", 10), ("e", "1", 5), ("f", "1", 5), ("f", "2", 6)], "source_id string, sha256 string, since_us bigint")
    active = spark.createDataFrame([("a", "3"), ("b", "3"), ("c", "1"), ("d", "2"), ("e", "1"), ("f", "1")], "source_id string, active string")
    assert {tuple(r) for r in reconcile.chain_breaks(events_, held, active).collect()} == {("b", 4, "prior_mismatch"), ("c", 5, "first_seen_differs"), ("c", 6, "adopted_again"), ("d", 7, "root_not_held"), ("f", None, "held_outside_chain")}


def test_fences_within_the_row(spark):
    text = "# a\n```\n# b\n```\n# c\n\n~~~ x\n# d\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x")], "id bigint, text string")
    assert sorted((r.doc, r.line_no, r.line) for r in markdown.outside_code(docs, "id", "text").collect()) == [(1, 1, "# a"), (1, 5, "# c"), (1, 6, ""), (4, 1, "x")]
    assert {(r.doc, r.line_no, r.offset) for r in markdown.line_offsets(spark.createDataFrame([(1, "a\r\nb\rc\n")], "id bigint, text string"), "id", "text").collect()} == {(1, 1, 0), (1, 2, 3), (1, 3, 5), (1, 4, 7)}
    rows = spark.createDataFrame([("k",), ("k",), ("m",)], "kind string").withColumn("at", F.monotonically_increasing_id())
    log = events.event_log(rows, ["at"]).collect()
    assert sorted((r.sequence, r.line, r.kind, r.n) for r in log if r.line != "header") == [(1, "event", "k", 1), (2, "event", "k", 1), (3, "event", "m", 1), (4, "trailer", "k", 2), (4, "trailer", "m", 1)]
