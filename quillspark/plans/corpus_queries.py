"""Queries of the corpus operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import hashing, markdown, strings
from quillspark.functions.keys import instant_us, norm_key
from quillspark.operators import citations, events, evidence, extraction, graph, ordering, publish, quality, reconcile, search
from quillspark.plans.corpus_sql import ORACLE  # noqa: F401
from quillspark.session import table
from quillspark.sources import ledger

TERMS = ("the registrar", "storage box", "Two of")
REQUEST = search.SearchRequest(terms=TERMS, context=2, page_size=200)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """One record a source: of repeated deliveries the last one updated."""
    rows = table(spark, d, "source_records").withColumn("source_id", norm_key("source_id"))
    picked = F.struct(*[c for c in rows.columns if c != "url_descriptor"])
    return rows.groupBy("source_id").agg(F.max_by(picked, F.struct(instant_us("updated_at"), picked)).alias("r")).select("r.*")


def literal_line_search(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(_docs(spark, d), "doc_id", "text", TERMS)


def search_candidates(spark: SparkSession, d: str) -> DataFrame:
    return search.candidates(_docs(spark, d), "text", TERMS).select("doc_id")


def search_with_context(spark: SparkSession, d: str) -> DataFrame:
    return search.lines_with_context(_docs(spark, d), "doc_id", "text", TERMS, 2)


def search_first_term(spark: SparkSession, d: str) -> DataFrame:
    return literal_line_search(spark, d).select("doc", "line_no", search.first_term(F.col("line"), TERMS).alias("term"))


def search_matched_terms(spark: SparkSession, d: str) -> DataFrame:
    return search.terms_of_documents(literal_line_search(spark, d), TERMS).select("doc", F.array_join("terms", "|").alias("terms"))


def first_hit_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return search.first_hits(literal_line_search(spark, d))


def search_pages(spark: SparkSession, d: str) -> DataFrame:
    return search.run_index(search.search_pages(_docs(spark, d), "doc_id", "text", REQUEST))


def search_run_proof(spark: SparkSession, d: str) -> DataFrame:
    return search.run_summary(search.search_pages(_docs(spark, d), "doc_id", "text", REQUEST)).select("n_pages", "n_matches", "complete")


def freshness_probe(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return search.restricted(_docs(spark, d), "doc_id", ids).groupBy("source").agg(F.count("*").alias("n"))


def link_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).withColumn("doc", F.col("doc_id").cast("string"))
    return search.link_candidates(docs, "doc", "text", "0", ("lighthouse journal", "parish roll"))


def content_ids(spark: SparkSession, d: str) -> DataFrame:
    sha = hashing.text_sha256(F.col("text"))
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    return _docs(spark, d).where("text is not null").select("doc_id", sha.alias("sha256"), hashing.source_id(path, sha).alias("source_key"), hashing.derivation_id(sha, F.lit("text"), F.lit("1"), F.lit("")).alias("derivation_key"))


def corpus_revision(spark: SparkSession, d: str) -> DataFrame:
    return hashing.corpus_revision(_sources(spark, d))


def corpus_revision_tree(spark: SparkSession, d: str) -> DataFrame:
    rows = hashing.revision_rows(_sources(spark, d))
    return hashing.tree_digest(rows, [F.lit(0)], [F.substring("source_id", 5, 2), F.substring("source_id", 5, 4)], F.col("row")).select("digest", "n")


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).where("text is not null").select("doc_id", hashing.text_sha256(F.col("text")).alias("sha256"))
    return graph.repeated(docs, ["sha256"])


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    live = table(spark, d, "inventory").select("path", "byte_size", "mtime_ns", norm_key("sha256").alias("sha256"), "url")
    # live rows that repeat a path: the greatest, so that SQL picks the same
    row = F.struct("byte_size", "mtime_ns", "sha256", "url")
    live = live.groupBy("path").agg(F.max(row).alias("r")).select("path", "r.*")
    records = _sources(spark, d).groupBy(F.col("current_raw_path").alias("path")).agg(F.min("source_id").alias("source_id"))
    known = _sources(spark, d).select("source_id", "byte_size", F.lit(None).cast("bigint").alias("mtime_ns"), norm_key("active_content_sha256").alias("sha256"), F.lit(None).cast("string").alias("url"))
    return live, records.join(known, "source_id")


def reconcile_decisions(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconcile(*_snapshots(spark, d))


def reconcile_actions(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.zero_filled(reconcile_decisions(spark, d), "action", reconcile.ACTIONS)


def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.zero_filled(_sources(spark, d), "state", reconcile.STATES)


def gaps_of(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of the ledger: unreadable files are skips, the codes of a source's failed extractions are its diagnostics."""
    skipped = table(spark, d, "inventory").where("sha256 is null").select("path", F.lit("raw_file_unavailable").alias("code")).distinct()
    codes = table(spark, d, "extracted_payloads").where("code is not null").groupBy(norm_key("source_id").alias("source_id")).agg(F.collect_set("code").alias("codes"))
    records = _sources(spark, d).select("source_id", "state", F.col("current_raw_path").alias("path")).join(codes, "source_id", "left")
    return reconcile.coverage_gaps(records, skipped)


def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return gaps_of(spark, d)


def adoption_chain_breaks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "adoption_events")
    row = F.struct(norm_key("source_id").alias("source_id"), norm_key("prior_sha256").alias("prior_sha256"), norm_key("adopted_sha256").alias("adopted_sha256"), instant_us("recorded_at").alias("at_us"))
    latest = e.groupBy("event_id").agg(F.max_by(row, "delivered_at").alias("r")).select("event_id", "r.*")
    held = table(spark, d, "content_versions").select(norm_key("source_id").alias("source_id"), norm_key("sha256").alias("sha256"), instant_us("first_seen_at").alias("us")).groupBy("source_id", "sha256").agg(F.min("us").alias("since_us"))
    return reconcile.chain_breaks(latest, held, _sources(spark, d).select("source_id", norm_key("active_content_sha256").alias("active")))


def _wiki(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", strings.unix_lines(F.col("text")).alias("text"))


def page_headings(spark: SparkSession, d: str) -> DataFrame:
    return markdown.headings(_wiki(spark, d), "doc_id", "text")


def section_extents(spark: SparkSession, d: str) -> DataFrame:
    return markdown.section_extents(page_headings(spark, d)).select("doc", "line_no", "level", F.coalesce("end_line", F.lit(-1)).alias("end_line"))


def skipped_levels(spark: SparkSession, d: str) -> DataFrame:
    return markdown.skipped_levels(page_headings(spark, d)).select("doc", "line_no", "level")


def page_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    front = markdown.frontmatter(F.col("text"))
    rows = _wiki(spark, d).select("doc_id", front.alias("f")).where("f is not null")
    return rows.select("doc_id", *[F.try_element_at("f", F.lit(k)).alias(k) for k in ("id", "title", "type")])


def citation_markers(spark: SparkSession, d: str) -> DataFrame:
    return citations.marker_counts(markdown.markers(_wiki(spark, d), "doc_id", "text"))


def undefined_markers(spark: SparkSession, d: str) -> DataFrame:
    w = _wiki(spark, d)
    return citations.undefined_markers(markdown.markers(w, "doc_id", "text"), markdown.definitions(w, "doc_id", "text")).select("doc", "line_no", "citation_id").distinct()


def note_path(doc: str) -> F.Column:
    """The file that a document stands in; its relations and links start there."""
    return F.concat(F.lit("wiki/notes/"), F.col(doc).cast("string"), F.lit(".md"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    rows = markdown.links(_wiki(spark, d), "doc_id", "text").select(note_path("doc").alias("doc"), "line_no", "label", "destination")
    return graph.resolved(rows, F.col("doc"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("doc", "line_no", "label", "destination")


def _named_pages(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and the name that links would give the page: the slug of the first alias."""
    front = markdown.frontmatter(F.col("text"))
    alias = F.lower(F.try_element_at(markdown.inline_list(F.try_element_at(front, F.lit("aliases"))), F.lit(1)))
    return _wiki(spark, d).select("doc_id", F.concat(F.lit("wiki/pages/"), alias, F.lit(".md")).alias("doc")).where("doc is not null")


def _page_names(spark: SparkSession, d: str) -> DataFrame:
    return _named_pages(spark, d).select("doc").distinct()


def link_targets_missing(spark: SparkSession, d: str) -> DataFrame:
    return graph.link_problems(_links(spark, d), _page_names(spark, d))


def reciprocity_violations(spark: SparkSession, d: str) -> DataFrame:
    """Changes of content that were never taken back: adoptions as directed edges."""
    edges = table(spark, d, "adoption_events").select(norm_key("prior_sha256").alias("a"), norm_key("adopted_sha256").alias("b"))
    return graph.one_way(edges.where("a <> b"))


def page_reciprocity(spark: SparkSession, d: str) -> DataFrame:
    """Relations that a page declares to another and that aren't returned, over all pages."""
    pages = _named_pages(spark, d).select(F.col("doc_id").alias("doc"), F.col("doc").alias("a"))
    edges = graph.resolved(page_relations(spark, d).select("doc", "destination").join(pages, "doc"), note_path("doc")).select("a", F.col("target").alias("b"))
    return graph.one_way(edges.where("a <> b"))


def ambiguous_names(spark: SparkSession, d: str) -> DataFrame:
    return graph.ambiguous_names(page_headings(spark, d).where("level = 1").select("doc", F.col("title").alias("name")))


def first_mentions(spark: SparkSession, d: str) -> DataFrame:
    return graph.first_mentions(markdown.running_text(_wiki(spark, d), "doc_id", "text"), ("lighthouse journal", "journal", "parish roll"))


def wiki_index(spark: SparkSession, d: str) -> DataFrame:
    titles = page_headings(spark, d).where("level = 1").groupBy("doc").agg(F.min_by("title", "line_no").alias("title"))
    return graph.index_lines(titles.select(F.concat(F.col("doc").cast("string"), F.lit(".md")).alias("path"), "title", F.when(F.col("title").endswith("?"), "question").otherwise("page").alias("kind"))).select("part", "path", "line")


def extractor_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = [("pdf", ["application/pdf"], [".pdf"]), ("image", ["image/png", "image/tiff", "image/jpeg"], [".png", ".tiff", ".jpg"]), ("webpage", [], [".url.md"]), ("text", ["text/plain"], [".txt", ".md"])]
    return table(spark, d, "inventory").select("path", ledger.choose_extractor(rows, F.col("path"), F.col("media_type")).alias("extractor_id")).distinct()


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rendered_captures").select("capture_id", strings.canonical_url(F.col("final_url")).alias("url")).distinct()


def md_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.array("n_name", F.col("n_nationkey").cast("string")))).alias("rows"))
    return rows.select("n_regionkey", extraction.table_payload(F.col("rows")).alias("markdown"))


def json_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.btrim(strings.canonical_json(F.col("props")), F.lit("\n")).alias("canonical"))


def line_anchors(spark: SparkSession, d: str) -> DataFrame:
    return extraction.line_anchors(_docs(spark, d).where("doc_id is not null"), "doc_id", "text").groupBy("doc").agg(F.count("*").alias("n_lines"), F.max(F.length("content")).cast("bigint").alias("longest"))


def ocr_accepted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_payloads").where("extractor_id in ('pdf', 'image') and markdown is not null")
    return rows.select("payload_id", extraction.ocr_accepted(F.col("markdown")).alias("accepted")).distinct()


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("path")
    rows = table(spark, d, "inventory").select("path", strings.file_name(c).alias("name"), strings.suffix(c).alias("suffix"), strings.parent(c).alias("parent"), strings.safe_filename(strings.file_name(c), F.col("media_type")).alias("safe"), strings.is_relative_posix(c).alias("relative"))
    return rows.distinct()


def strict_instants(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(strings.strict_utc(F.col("created_at")))
    return table(spark, d, "source_records").select("source_id", "created_at", at.alias("created_us")).distinct()


def page_relations(spark: SparkSession, d: str) -> DataFrame:
    return markdown.relations(_wiki(spark, d), "doc_id", "text")


def label_spans(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_spans(markdown.numbered_lines(_wiki(spark, d), "doc_id", "text"))


def retained_versions(spark: SparkSession, d: str) -> DataFrame:
    """Held contents per source, and the bytes they take."""
    v = table(spark, d, "content_versions").select(norm_key("source_id").alias("source_id"), norm_key("sha256").alias("sha256"), "byte_size").groupBy("source_id", "sha256").agg(F.max("byte_size").alias("byte_size"))
    return v.groupBy("source_id").agg(F.count("*").alias("n_versions"), F.sum("byte_size").alias("total_bytes"))


def hashed_twice(spark: SparkSession, d: str) -> DataFrame:
    """Live paths that hold the same bytes."""
    i = table(spark, d, "inventory").where("sha256 is not null").select("path", norm_key("sha256").alias("sha256")).distinct()
    return graph.repeated(i, ["sha256"])


def anchor_problems(spark: SparkSession, d: str) -> DataFrame:
    return extraction.anchor_problems(table(spark, d, "extracted_payloads").where("markdown is not null"), "payload_id", "markdown", "anchors").distinct()


def citation_integrity(spark: SparkSession, d: str) -> DataFrame:
    return citations.citation_integrity(*[table(spark, d, t) for t in ("citations", "source_records", "content_versions", "extracted_payloads")])


def conflicting_evidence(spark: SparkSession, d: str) -> DataFrame:
    return citations.conflicting_evidence(table(spark, d, "citations").where("document is not null"), ["document"])


def evidence_packet(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    runs = spark.createDataFrame([(p, f"run-{p}", "r1", True) for p in search.PASSES], "search_pass string, run_id string, revision string, complete boolean")
    rows = None
    for p, term in zip(search.PASSES, TERMS):
        hits = search.matching_lines(docs, "doc_id", "text", (term,)).select(F.lit(f"run-{p}").alias("run_id"), "doc", "line_no")
        rows = hits if rows is None else rows.unionByName(hits)
    return evidence.packet(runs, rows)


def reference_problems(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "citations").where("citation_id is not null").select("document", "citation_id", "anchor_kind").distinct()
    key = ["document", "citation_id"]
    return evidence.reference_problems(c.where("anchor_kind = 'page'"), c.where("anchor_kind = 'line'"), c.where("anchor_kind <> 'page'"), key)


def event_sequence_check(spark: SparkSession, d: str) -> DataFrame:
    return events.sequence_gaps(table(spark, d, "events"), ["user_id"], "event_id")


def event_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return events.kind_counts(table(spark, d, "events"), ("click", "view", "purchase", "signup", "error", "refund"))


def event_digest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("props is not null")
    return events.digests(e, [F.col("event_type")], F.col("event_id"), F.col("props")).withColumnRenamed("g0", "event_type")


def bounded_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).where("n_chars is not null").select("doc_id", "n_chars")
    return ordering.bounded_sample(docs, ["doc_id"], F.col("n_chars"), 100, 32 << 10)


def postimage_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", "text")
    after = docs.select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 1_000_000_000).otherwise(0)).alias("doc_id"), F.when(F.col("doc_id") % 7 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"))
    return publish.difference(docs, after, "doc_id", "text").select("doc_id", "change")


def dropped_markers(spark: SparkSession, d: str) -> DataFrame:
    m = markdown.markers(_wiki(spark, d), "doc_id", "text").select("doc", "citation_id")
    return publish.dropped(m, m.where("doc % 3 <> 0")).groupBy("doc").agg(F.count("*").alias("n_dropped"))


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    names = {r.table for r in quality.RULES}
    report = quality.quality_report({t: table(spark, d, t) for t in names})
    return report.groupBy("rule_id").agg(F.count("*").alias("n"))


def quality_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every violating row."""
    names = {r.table for r in quality.RULES}
    return quality.quality_report({t: table(spark, d, t) for t in names}).select("rule_id", "path", "details")


def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    names = {r.table for r in quality.RULES}
    return quality.status(_sources(spark, d), table(spark, d, "inventory"), {t: table(spark, d, t) for t in names})


QUERIES = {
    f.__name__: f
    for f in (
        literal_line_search, search_candidates, search_with_context, search_first_term, search_matched_terms, first_hit_per_doc, search_pages, search_run_proof, freshness_probe, link_candidates, content_ids, corpus_revision,
        corpus_revision_tree, exact_duplicates, reconcile_decisions, reconcile_actions, state_counts, coverage_gaps, adoption_chain_breaks, page_headings, section_extents, skipped_levels, page_frontmatter, citation_markers,
        undefined_markers, page_links, link_targets_missing, reciprocity_violations, page_reciprocity, ambiguous_names, first_mentions, wiki_index, extractor_choice, canonical_urls, md_table, json_blocks, line_anchors, ocr_accepted,
        path_parts, strict_instants, page_relations, label_spans, retained_versions, hashed_twice, anchor_problems, citation_integrity, conflicting_evidence, evidence_packet, reference_problems, event_sequence_check, event_kind_counts, event_digest, bounded_sample, postimage_diff, dropped_markers, quality_report, quality_rows, status_rollup,
    )
}

