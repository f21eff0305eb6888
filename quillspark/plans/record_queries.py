"""Queries of the operators over records, events, handoffs and texts, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import hashing, markdown, strings
from quillspark.functions.keys import instant_us, micros, norm_key
from quillspark.operators import citations, events, evidence, extraction, graph, handoffs, ordering, publish, reconcile, search, validation
from quillspark.plans import corpus_queries as corpus
from quillspark.plans.corpus_sql import _DECISIONS, _MARKED, _SOURCES, FENCED, WIKI
from quillspark.plans.ledger_queries import _key
from quillspark.session import table
from quillspark.sources import files, ledger

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Adoption events with normal keys; a delivery that is repeated as it stands counts once."""
    e = table(spark, d, "adoption_events")
    return e.select("event_id", norm_key("source_id").alias("source_id"), norm_key("prior_sha256").alias("prior_sha256"), norm_key("adopted_sha256").alias("adopted_sha256"), "approval_note", instant_us("recorded_at").alias("at_us"), micros("delivered_at").alias("delivered_us")).distinct()


_EV = f"ev AS (SELECT DISTINCT event_id, {_key('source_id')} AS source_id, {_key('prior_sha256')} AS prior_sha256, {_key('adopted_sha256')} AS adopted_sha256, approval_note, epoch_us(try_cast(recorded_at AS TIMESTAMPTZ)) AS at_us, epoch_us(delivered_at) AS delivered_us FROM adoption_events)"


def _latest(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct("delivered_us", "adopted_sha256", "source_id", "prior_sha256", "approval_note", "at_us")
    return _deliveries(spark, d).groupBy("event_id").agg(F.max(row).alias("r")).select("event_id", "r.*")


_LATEST = _EV + ", latest AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY delivered_us DESC, adopted_sha256 DESC NULLS LAST, source_id DESC NULLS LAST, prior_sha256 DESC NULLS LAST, approval_note DESC NULLS LAST, at_us DESC NULLS LAST) = 1)"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_versions").select(norm_key("source_id").alias("source_id"), norm_key("sha256").alias("sha256")).distinct()


_HELD = f"held AS (SELECT DISTINCT {_key('source_id')} AS source_id, {_key('sha256')} AS sha256 FROM content_versions)"


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """The last extraction of each source."""
    row = F.struct(micros("created_at").alias("created_us"), "payload_id", norm_key("content_sha256").alias("content_sha256"), norm_key("derivation_id").alias("derivation_id"), "extractor_id", "extractor_version", "state", "code")
    return table(spark, d, "extracted_payloads").where("source_id is not null and created_at is not null").groupBy(norm_key("source_id").alias("source_id")).agg(F.max(row).alias("r")).select("source_id", "r.*")


_LAST = f"""last AS (SELECT * FROM (SELECT {_key('source_id')} AS source_id, epoch_us(created_at) AS created_us, payload_id, {_key('content_sha256')} AS content_sha256, {_key('derivation_id')} AS derivation_id, extractor_id, extractor_version, state, code FROM extracted_payloads WHERE source_id IS NOT NULL AND created_at IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_us DESC, payload_id DESC) = 1)"""


# the ledger and its events


@query(f"WITH {_LATEST} SELECT event_id, adopted_sha256 FROM latest")
def upserted_events(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of an event replaces the first."""
    e = _deliveries(spark, d)
    first = e.groupBy("event_id").agg(F.min(F.struct("delivered_us", "adopted_sha256")).alias("r")).select("event_id", "r.adopted_sha256")
    again = e.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select("event_id")
    return ledger.upsert(first, _latest(spark, d).join(again, "event_id", "left_semi").select("event_id", "adopted_sha256"), "event_id")


@query(f"WITH {_EV} SELECT DISTINCT a.event_id, b.adopted_sha256 AS old, a.adopted_sha256 AS new FROM ev a JOIN ev b ON a.event_id = b.event_id WHERE a.adopted_sha256 <> b.adopted_sha256")
def event_collisions(spark: SparkSession, d: str) -> DataFrame:
    """A10: events delivered with different contents."""
    e = _deliveries(spark, d)
    return ledger.collisions(e, e, "event_id", "adopted_sha256").distinct()


@query("SELECT handoff_id, count(DISTINCT final_url) AS n_bodies FROM rendered_captures GROUP BY 1 HAVING count(DISTINCT final_url) > 1")
def handoff_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Handoffs that stand for more than one page; captures without a handoff are one more."""
    return ledger.handoff_collisions(table(spark, d, "rendered_captures").select("handoff_id", F.col("final_url").alias("body")))


@query(f"""WITH {_LATEST}, log AS (SELECT *, row_number() OVER (ORDER BY event_id) AS sequence, coalesce(approval_note, 'none') AS kind FROM latest)
SELECT 0::BIGINT AS sequence, 'header' AS line, NULL::VARCHAR AS kind, count(*) AS n FROM log UNION ALL SELECT sequence, 'event', kind, 1 FROM log UNION ALL SELECT (SELECT count(*) FROM log) + 1, 'trailer', kind, count(*) FROM log GROUP BY kind""")
def event_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of a header, events numbered from 1 and a trailer with the count of each kind."""
    rows = _latest(spark, d).select("event_id", F.coalesce("approval_note", F.lit("none")).alias("kind"))
    return events.event_log(rows, ["event_id"]).select("sequence", "line", "kind", "n")


@query(f"WITH {_SOURCES}, {_LATEST} SELECT event_id FROM latest l WHERE approval_note = 'approved' OR EXISTS (SELECT 1 FROM sources s WHERE s.source_id = l.source_id AND {_key('s.active_content_sha256')} = l.adopted_sha256)")
def current_events(spark: SparkSession, d: str) -> DataFrame:
    """C14: approved events are committed rewrites and stay; the others only while their record is as they say."""
    e = _latest(spark, d).select("event_id", F.when(F.col("approval_note") == "approved", "rewrite").otherwise("action").alias("kind"), (F.col("approval_note") == "approved").alias("committed"), "source_id", F.col("adopted_sha256").alias("record_sha256"))
    return events.current_events(e, corpus._sources(spark, d).select("source_id", norm_key("active_content_sha256").alias("record_sha256"))).select("event_id")


@query(f"WITH {_EV} SELECT event_id FROM ev GROUP BY 1 HAVING count(*) = 1")
def pending_events(spark: SparkSession, d: str) -> DataFrame:
    """Results that nobody has acknowledged; an event delivered again was acknowledged."""
    e = _deliveries(spark, d).select(F.col("event_id").alias("result_id"))
    receipts = e.groupBy("result_id").agg((F.count("*") > 1).alias("acknowledged"))
    return events.pending(e.distinct(), receipts).select(F.col("result_id").alias("event_id"))


@query("SELECT document, citation_id, citation_key, row_number() OVER (PARTITION BY document, citation_id ORDER BY citation_key) - 1 AS occurrence FROM (SELECT DISTINCT document, citation_id, citation_key FROM citations)")
def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """number of each citation among those of one name in its document."""
    return events.occurrence(table(spark, d, "citations").select("document", "citation_id", "citation_key").distinct(), ["document", "citation_id"], ["citation_key"])


@query(f"""{_DECISIONS}, {_LAST}, adopted AS (SELECT DISTINCT {_key('source_id')} AS source_id, {_key('adopted_sha256')} AS sha256 FROM adoption_events),
judged AS (SELECT d.path, d.source_id, d.action, s.state, last.state AS outcome, EXISTS (SELECT 1 FROM adopted a WHERE a.source_id = d.source_id AND a.sha256 = l.sha256) AS adopted FROM decisions d JOIN sources s ON s.source_id = d.source_id LEFT JOIN live l ON l.path = d.path LEFT JOIN last ON last.source_id = d.source_id)
SELECT path, source_id, action, CASE WHEN action = 'integrity_error' AND NOT adopted THEN 'integrity_error' WHEN action = 'missing' THEN CASE WHEN state = 'awaiting_approval' THEN state ELSE 'warning' END WHEN state = 'extracting' THEN 'pending'
  WHEN action IN ('create', 'process', 'integrity_error') THEN coalesce(outcome, 'pending') ELSE state END AS next FROM judged""")
def states_after_sync(spark: SparkSession, d: str) -> DataFrame:
    """The state of each source after its decision; changed bytes stay an error until they are adopted."""
    live, _ = corpus._snapshots(spark, d)
    made = corpus.reconcile_decisions(spark, d).where("source_id is not null").join(live.select("path", "sha256"), "path", "left")
    adopted = _deliveries(spark, d).select("source_id", F.col("adopted_sha256").alias("sha256")).distinct().withColumn("adopted", F.lit(True))
    judged = made.join(adopted, ["source_id", "sha256"], "left").join(corpus._sources(spark, d).select("source_id", "state"), "source_id").join(_payloads(spark, d).select("source_id", F.col("state").alias("outcome")), "source_id", "left")
    return judged.select("path", "source_id", "action", reconcile.next_state(F.col("state"), F.col("action"), F.col("outcome"), F.col("adopted")).alias("next"))


@query(f"""{_DECISIONS}, {_LATEST} SELECT d.source_id, l.prior_sha256, l.adopted_sha256, l.approval_note, l.at_us AS recorded_at FROM decisions d JOIN sources s ON s.source_id = d.source_id JOIN live v ON v.path = d.path
JOIN latest l ON l.source_id = d.source_id AND l.prior_sha256 = {_key('s.active_content_sha256')} AND l.adopted_sha256 = v.sha256 WHERE d.action = 'integrity_error'""")
def adoptable_errors(spark: SparkSession, d: str) -> DataFrame:
    """P10: changed bytes whose adoption is approved."""
    live, _ = corpus._snapshots(spark, d)
    errors = corpus.reconcile_decisions(spark, d).where("action = 'integrity_error'").join(live.select("path", F.col("sha256").alias("adopted_sha256")), "path").join(corpus._sources(spark, d).select("source_id", norm_key("active_content_sha256").alias("prior_sha256")), "source_id")
    return reconcile.adopt_versions(errors, _latest(spark, d).withColumnRenamed("at_us", "recorded_at"))


@query(f"""WITH {_SOURCES}, d AS (SELECT path, max(url) AS url, max(description) AS description FROM inventory WHERE url IS NOT NULL GROUP BY 1), r AS (SELECT DISTINCT current_raw_path AS path, url_descriptor.url AS old_url, url_descriptor.description AS old_description FROM source_records WHERE url_descriptor.url IS NOT NULL)
SELECT path, CASE WHEN url <> old_url THEN 'address_changed' WHEN description IS DISTINCT FROM old_description THEN 'described_anew' ELSE 'unchanged' END AS change, url <> old_url AS clears_active FROM d JOIN r USING (path)""")
def descriptor_edits(spark: SparkSession, d: str) -> DataFrame:
    """A new description keeps the source, a new address clears what is active."""
    live = table(spark, d, "inventory").where("url is not null").groupBy("path").agg(F.max("url").alias("url"), F.max("description").alias("description"))
    known = table(spark, d, "source_records").where("url_descriptor.url is not null").select(F.col("current_raw_path").alias("path"), F.col("url_descriptor.url").alias("old_url"), F.col("url_descriptor.description").alias("old_description")).distinct()
    change = reconcile.descriptor_change(F.col("old_url"), F.col("old_description"), F.col("url"), F.col("description"))
    return live.join(known, "path").select("path", change.alias("change"), (change == "address_changed").alias("clears_active"))


@query(f"""WITH {_SOURCES}, {_LAST}, latest AS (SELECT extractor_id, max(extractor_version) AS v FROM extracted_payloads GROUP BY 1)
SELECT s.source_id, last.source_id IS NULL OR last.content_sha256 IS DISTINCT FROM {_key('s.active_content_sha256')} OR last.extractor_version IS DISTINCT FROM latest.v AS retry FROM sources s LEFT JOIN last ON last.source_id = s.source_id LEFT JOIN latest ON latest.extractor_id = last.extractor_id""")
def retries(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose last attempt differs from what an attempt would be today."""
    newest = table(spark, d, "extracted_payloads").groupBy("extractor_id").agg(F.max("extractor_version").alias("newest"))
    rows = corpus._sources(spark, d).select("source_id", norm_key("active_content_sha256").alias("active")).join(_payloads(spark, d), "source_id", "left").join(newest, "extractor_id", "left")
    none = F.lit(None).cast("string")
    identity = lambda sha, version: F.struct(sha.alias("input_sha256"), F.col("extractor_id").alias("extractor_id"), version.alias("extractor_version"), none.alias("config_sha256"), none.alias("prerequisite_digest"), F.coalesce("state", F.lit("interrupted")).alias("outcome"))
    attempt = F.when(F.col("payload_id").isNotNull(), identity(F.col("content_sha256"), F.col("extractor_version")))
    return rows.select("source_id", attempt.alias("attempt"), identity(F.col("active"), F.col("newest")).alias("now")).select("source_id", reconcile.retry_needed("attempt", "now").alias("retry"))


@query(f"WITH {_SOURCES}, {_LAST} SELECT s.source_id, {_key('s.active_derivation_id')} IS NOT DISTINCT FROM last.derivation_id AS current FROM sources s LEFT JOIN last ON last.source_id = s.source_id")
def current_derivations(spark: SparkSession, d: str) -> DataFrame:
    """C11: whether the active derivation is the one that the last extraction gave."""
    rows = corpus._sources(spark, d).join(_payloads(spark, d).select("source_id", "derivation_id"), "source_id", "left")
    return rows.select("source_id", reconcile.is_current(norm_key("active_derivation_id"), F.col("derivation_id")).alias("current"))


@query(f"WITH {_SOURCES} SELECT source_id FROM sources WHERE active_derivation_id IS NOT NULL AND state IN ('ok', 'warning')")
def active_sources(spark: SparkSession, d: str) -> DataFrame:
    """C4: sources that a search covers."""
    return search.active_representations(corpus._sources(spark, d)).select("source_id")


@query(f"""WITH {_SOURCES}, g AS (SELECT NULL::VARCHAR AS source_id, 'raw_file_unavailable' AS code, path FROM (SELECT DISTINCT path FROM inventory WHERE sha256 IS NULL)
UNION ALL SELECT s.source_id, coalesce(c.code, 'source_' || s.state), s.current_raw_path FROM sources s LEFT JOIN (SELECT DISTINCT {_key('source_id')} AS source_id, code FROM extracted_payloads WHERE code IS NOT NULL) c ON c.source_id = s.source_id WHERE s.state IN ('pending', 'warning', 'needs_agent', 'failed', 'unsupported', 'integrity_error', 'awaiting_approval'))
SELECT * FROM g ORDER BY path NULLS FIRST, code, source_id NULLS FIRST LIMIT 100""")
def smallest_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The hundred gaps that come first; the limit is the report's own."""
    return ordering.smallest(corpus.gaps_of(spark, d), ["path", "code", "source_id"], 100)


# handoffs


@query("""SELECT handoff_id AS approval_event_id, count(DISTINCT (detected_media_type, sha256, epoch_us(retrieved_at))) AS n FROM rendered_captures WHERE handoff_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (detected_media_type, sha256, epoch_us(retrieved_at))) > 1""")
def approval_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Approvals that stand for more than one scope, note and time."""
    c = table(spark, d, "rendered_captures")
    return handoffs.approval_conflicts(c.select(F.col("handoff_id").alias("approval_event_id"), F.col("detected_media_type").alias("approval_scope"), F.col("sha256").alias("approval_note"), micros("retrieved_at").alias("approval_recorded_at"))).select("approval_event_id", "n")


@query(f"""WITH {_SOURCES}, {_LAST}, latest AS (SELECT extractor_id, max(extractor_version) AS v FROM extracted_payloads WHERE extractor_id <> 'docx' GROUP BY 1)
SELECT s.source_id, last.extractor_id, CASE WHEN latest.extractor_id IS NULL THEN 'recipe_missing' WHEN last.extractor_version IS DISTINCT FROM latest.v THEN 'recipe_changed' END AS code FROM sources s LEFT JOIN last ON last.source_id = s.source_id LEFT JOIN latest ON latest.extractor_id = last.extractor_id WHERE s.state = 'needs_agent'""")
def open_handoffs(spark: SparkSession, d: str) -> DataFrame:
    """Sources that need an agent, and whether the recipe of their last attempt still holds; docx has none."""
    none = F.lit(None).cast("string")
    attempt = F.struct(F.col("content_sha256").alias("input_sha256"), "extractor_id", "extractor_version", none.alias("config_sha256"), none.alias("prerequisite_digest"))
    records = corpus._sources(spark, d).select("source_id", "state").join(_payloads(spark, d).select("source_id", attempt.alias("last_attempt")), "source_id", "left")
    recipes = table(spark, d, "extracted_payloads").where("extractor_id <> 'docx'").groupBy("extractor_id").agg(F.max("extractor_version").alias("extractor_version")).withColumns({"config_sha256": none, "prerequisite_digest": none})
    return handoffs.open_handoffs(records, recipes)


@query(f"WITH {_HELD} SELECT DISTINCT capture_id, {_key('source_id')} AS source_id, {_key('sha256')} AS input_sha256 FROM rendered_captures c WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.source_id = {_key('c.source_id')} AND h.sha256 = {_key('c.sha256')})")
def unheld_captures(spark: SparkSession, d: str) -> DataFrame:
    """Captures whose content is no longer held."""
    c = table(spark, d, "rendered_captures").select("capture_id", norm_key("source_id").alias("source_id"), norm_key("sha256").alias("input_sha256")).distinct()
    return handoffs.unheld(c, _versions(spark, d)).select("capture_id", "source_id", "input_sha256")


@query("""WITH p AS (SELECT DISTINCT payload_id, extractor_id, extractor_version, anchors FROM extracted_payloads), h AS (SELECT payload_id, CASE WHEN payload_id % 11 = 0 THEN extractor_version || '.1' ELSE extractor_version END AS v, CASE extractor_id WHEN 'pdf' THEN 'page' WHEN 'image' THEN 'page' ELSE 'line' END AS k FROM (SELECT DISTINCT payload_id, extractor_id, extractor_version FROM extracted_payloads) WHERE payload_id % 7 <> 0)
SELECT DISTINCT * FROM (SELECT p.payload_id::VARCHAR AS handoff_id, CASE WHEN h.payload_id IS NULL THEN 'handoff_unknown' WHEN h.v <> p.extractor_version THEN 'attempt_changed' WHEN NOT list_contains(list_transform(coalesce(anchors, []), lambda a: a.kind), h.k) THEN 'anchor_kind_missing' END AS code FROM p LEFT JOIN h ON h.payload_id = p.payload_id) WHERE code IS NOT NULL""")
def extraction_problems(spark: SparkSession, d: str) -> DataFrame:
    """Outputs against handoffs that lack every seventh and ask every eleventh for another version."""
    none = F.lit(None).cast("string")
    attempt = lambda version: F.struct(none.alias("input_sha256"), F.col("extractor_id"), version.alias("extractor_version"), none.alias("config_sha256"), none.alias("prerequisite_digest"))
    p = table(spark, d, "extracted_payloads").select("payload_id", "extractor_id", "extractor_version", "anchors").distinct()
    outputs = p.select(F.col("payload_id").cast("string").alias("handoff_id"), attempt(F.col("extractor_version")).alias("attempt"), "anchors")
    asked = F.when(F.col("payload_id") % 11 == 0, F.concat("extractor_version", F.lit(".1"))).otherwise(F.col("extractor_version"))
    kinds = F.array(F.when(F.col("extractor_id").isin("pdf", "image"), "page").otherwise("line"))
    given = p.drop("anchors").distinct().where("payload_id % 7 <> 0").select(F.col("payload_id").cast("string").alias("handoff_id"), attempt(asked).alias("attempt"), kinds.alias("required_kinds"))
    return handoffs.extraction_problems(outputs, given).distinct()


@query(f"""WITH {_SOURCES}, {_LATEST}, e AS (SELECT event_id, source_id, adopted_sha256 AS r, CASE WHEN approval_note IS NULL THEN 'handoff' ELSE 'action' END AS kind, CASE WHEN approval_note IS NULL THEN source_id END AS h FROM latest), n AS (SELECT {_key('source_id')} AS h, count(*) AS n FROM rendered_captures GROUP BY 1)
SELECT * FROM (SELECT event_id AS sequence, CASE WHEN s.active IS NULL THEN 'source_unknown' WHEN s.active IS DISTINCT FROM r THEN 'record_changed' WHEN kind = 'handoff' AND coalesce(n, 0) <> 1 THEN 'handoff_not_one' END AS code FROM e LEFT JOIN (SELECT source_id, {_key('active_content_sha256')} AS active FROM sources) s ON s.source_id = e.source_id LEFT JOIN n ON n.h = e.h) WHERE code IS NOT NULL""")
def event_problems(spark: SparkSession, d: str) -> DataFrame:
    """Events against the ledger as it is and the handoffs they name."""
    e = _latest(spark, d).select(F.col("event_id").alias("sequence"), F.when(F.col("approval_note").isNull(), "handoff").otherwise("action").alias("kind"), "source_id", F.col("adopted_sha256").alias("record_sha256"), F.when(F.col("approval_note").isNull(), F.col("source_id")).alias("handoff_id"))
    records = corpus._sources(spark, d).select("source_id", norm_key("active_content_sha256").alias("record_sha256"))
    return handoffs.event_problems(e, records, table(spark, d, "rendered_captures").select(norm_key("source_id").alias("handoff_id")))


@query("""WITH p AS (SELECT user_id, event_id, event_type, 'c' || event_id AS next, lag('c' || event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS given FROM events)
SELECT user_id AS run_id, event_id AS page FROM p WHERE event_type = 'error' AND given IS NOT NULL""")
def cursor_breaks(spark: SparkSession, d: str) -> DataFrame:
    """pages not asked for with the cursor of the page before; here those of errors lost theirs."""
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("next_cursor", F.concat(F.lit("c"), F.col("event_id").cast("string")))
    given = F.lag("next_cursor").over(Window.partitionBy("user_id").orderBy("event_id"))
    return handoffs.cursor_breaks(e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("page"), F.when(F.col("event_type") != "error", given).alias("request_cursor"), "next_cursor"))


# extraction


@query("""SELECT DISTINCT payload_id, CASE WHEN code IS NULL THEN 'ok' WHEN extractor_id IN ('pdf', 'image', 'webpage') AND (code = 'empty_extraction' OR extractor_id = 'image' AND code = 'ocr_low_confidence') THEN 'needs_agent' ELSE 'failed' END AS state FROM extracted_payloads""")
def outcome_states(spark: SparkSession, d: str) -> DataFrame:
    """What failures lead to, where agents may help with scans and pages."""
    p = table(spark, d, "extracted_payloads")
    code = F.when(F.col("code") == "ocr_low_confidence", "low_confidence_ocr").otherwise(F.col("code"))
    return p.select("payload_id", extraction.outcome_state(code, F.col("extractor_id"), F.col("extractor_id").isin("pdf", "image", "webpage")).alias("state")).distinct()


@query("""WITH c AS (SELECT n_regionkey, '"' || n_name || '",' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ',"a|b' || chr(10) || '<c>"' ELSE '' END AS row, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation)
SELECT n_regionkey, '| Column 1 | Column 2 | Column 3 | Source row |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN 'a\\|b<br>&lt;c&gt;' ELSE '' END || ' | <a id="row:' || i || '"></a> |', chr(10) ORDER BY i) || chr(10) AS markdown FROM c GROUP BY 1""")
def delimited_tables(spark: SparkSession, d: str) -> DataFrame:
    """Delimited text with quotes, line ends in cells and ragged rows to tables."""
    more = F.when(F.col("n_nationkey") % 2 == 0, ',"a|b\n<c>"').otherwise("")
    rows = table(spark, d, "nation").select("n_regionkey", "n_name", F.concat(F.lit('"'), "n_name", F.lit('",'), F.col("n_nationkey").cast("string"), more).alias("row"))
    texts = rows.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "row"))), lambda r: r["row"]), "\n").alias("text"))
    return texts.select("n_regionkey", extraction.delimited_payload(F.col("text")).alias("markdown"))


@query("""SELECT event_id, '<a id="block:1"></a>' || chr(10) || chr(10) || '```json' || chr(10) || '{' || chr(10) || '  "k": ' || (props->>'$.k') || chr(10) || '}' || chr(10) || '```' || chr(10) || chr(10) || '<a id="block:2"></a>' || chr(10) || chr(10) || '```json' || chr(10) || event_id || chr(10) || '```' || chr(10) AS markdown FROM events WHERE props IS NOT NULL""")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two values a text, a blank line between them."""
    text = F.concat("props", F.lit("\n\n"), F.col("event_id").cast("string"))
    return table(spark, d, "events").where("props is not null").select("event_id", extraction.json_payload(text, lines=True).alias("markdown"))


@query("""SELECT event_id, '## ' || event_type || chr(10) || chr(10) || user_id || chr(10) || event_id || chr(10) || chr(10) || '- &lt;a&gt;' || chr(10) || '-  b c' AS text FROM events""")
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """Pages with hidden elements, blocks, line breaks, lists and cells to text."""
    page = F.concat(F.lit("<head><title>t</title></head><script>x<p></script><h2>"), "event_type", F.lit("</h2><svg><p>y</svg><p>"), F.col("user_id").cast("string"), F.lit("<br>"), F.col("event_id").cast("string"), F.lit("</p>\n \n<ul><li>&lt;a&gt;<li><math>z</math><td>b<td>c</ul>"))
    return table(spark, d, "events").select("event_id", extraction.html_text(page).alias("text"))


@query("""SELECT doc_id AS doc, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::VARCHAR AS anchor_value, length(s) AS n_chars FROM (
  SELECT doc_id, i, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '<a id="((line|page|slide|sheet|section|row|block):[A-Za-z0-9._:/-]+)"></a>', '&lt;a id="\\1"&gt;&lt;/a&gt;', 'g'), '(?m)^(#{1,6} )', chr(1114109) || '\\1', 'g'), chr(1114109)) AS parts FROM documents WHERE text IS NOT NULL))) WHERE s <> ''""")
def text_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections that begin at headings, numbered."""
    docs = table(spark, d, "documents").where("text is not null")
    return extraction.numbered_parts(docs, "doc_id", extraction.sections(F.col("text")), "section").select("doc", "anchor_value", F.length("content").cast("bigint").alias("n_chars"))


@query("""SELECT DISTINCT payload_id, len(string_split(regexp_replace(markdown, '<a id="page:[0-9]+"></a>', chr(12), 'g'), chr(12))) - CASE WHEN regexp_matches(markdown, '<a id="page:[0-9]+"></a> *$') THEN 1 ELSE 0 END AS n_pages FROM extracted_payloads WHERE extractor_id = 'pdf' AND markdown IS NOT NULL""")
def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    """Form feeds part the pages of converted text; a last blank page is dropped."""
    p = table(spark, d, "extracted_payloads").where("extractor_id = 'pdf' and markdown is not null")
    pages = extraction.form_feed_pages(F.regexp_replace("markdown", '<a id="page:[0-9]+"></a>', "\f"))
    return p.select("payload_id", F.size(pages).cast("bigint").alias("n_pages")).distinct()


@query("""SELECT DISTINCT path, url, description, added FROM inventory WHERE url IS NOT NULL AND NOT contains(url || coalesce(description, ''), '"') AND description IS NOT NULL AND added IS NOT NULL""")
def url_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """A5: descriptors written as text and read back."""
    rows = table(spark, d, "inventory").where("url is not null and not contains(concat(url, coalesce(description, '')), '\"') and description is not null and added is not null")
    text = F.concat(F.lit('---\nkind: url\nurl: "'), "url", F.lit('"\ndescription: "'), "description", F.lit('"\nadded: '), F.col("added").cast("string"), F.lit("\n---\n"))
    return rows.select("path", files.descriptor(text).alias("f")).select("path", "f.url", "f.description", "f.added").distinct()


@query("""SELECT DISTINCT path, regexp_matches(path, '(^|/)\\.(gitkeep|keep|DS_Store)$|^(_versions|_web)/') AS ignored, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '([^.])\\.[^.]+$', '\\1') AS stem FROM (SELECT path FROM inventory UNION ALL SELECT '_versions/' || path FROM inventory UNION ALL SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) || '/.DS_Store' FROM inventory)""")
def ignored_paths(spark: SparkSession, d: str) -> DataFrame:
    """A2: live paths, paths of kept versions, and system files beside them."""
    p = table(spark, d, "inventory").select("path")
    every = p.unionByName(p.select(F.concat(F.lit("_versions/"), "path").alias("path"))).unionByName(p.select(F.concat(strings.parent(F.col("path")), F.lit("/.DS_Store")).alias("path")))
    return every.select("path", files.is_ignored(F.col("path")).alias("ignored"), strings.stem(F.col("path")).alias("stem")).distinct()


@query("SELECT DISTINCT payload_id, extractor_version || '+' || content_sha256 AS effective, extractor_version AS version, content_sha256 AS digest FROM extracted_payloads WHERE content_sha256 IS NOT NULL")
def effective_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions with their digest, and both parted again."""
    whole = hashing.effective_version(F.col("extractor_version"), F.col("content_sha256"))
    rows = table(spark, d, "extracted_payloads").where("content_sha256 is not null").select("payload_id", whole.alias("effective"))
    return rows.select("payload_id", "effective", hashing.split_version(F.col("effective")).alias("s")).select("payload_id", "effective", "s.version", "s.digest").distinct()


@query("SELECT doc_id, regexp_matches(text, '[\\x00-\\x1f\\x7f-\\x{9f}]') AS control, octet_length(encode(text)) AS n_bytes, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    """Control characters, bytes and code points."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", strings.has_control(t).alias("control"), F.octet_length(t).cast("bigint").alias("n_bytes"), F.length(t).cast("bigint").alias("n_chars"))


@query("""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n|\\r|\\n', '\\0' || chr(1114109), 'g'), chr(1114109)) AS l FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM p)
SELECT doc_id AS doc, i AS line_no, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM r""")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    """where each physical line begins; CR, LF and CRLF end lines."""
    return markdown.line_offsets(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT capture_id, 'src_' || sha256('source-v1' || chr(0) || '_web/' || capture_id || chr(0) || """ + _key("sha256") + """) AS source_key, trim(split_part(lower(detected_media_type), ';', 1)) AS media FROM (SELECT DISTINCT capture_id, sha256, detected_media_type FROM rendered_captures WHERE sha256 IS NOT NULL)""")
def web_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Captures as new sources: identity, media type without parameters."""
    c = table(spark, d, "rendered_captures").where("sha256 is not null").select("capture_id", "sha256", "detected_media_type").distinct()
    return c.select("capture_id", hashing.source_id(F.concat(F.lit("_web/"), F.col("capture_id").cast("string")), norm_key("sha256")).alias("source_key"), strings.media_type(F.col("detected_media_type")).alias("media"))


# pages, citations, publishing

_DEFS = _MARKED + ", defs AS (SELECT doc, line_no, regexp_extract(line, '^\\[\\^([^\\]\\s]+)\\]:', 1) AS citation_id FROM outside WHERE regexp_matches(line, '^\\[\\^([^\\]\\s]+)\\]:'))"


@query(f"WITH {_DEFS} SELECT doc, line_no, citation_id FROM defs d WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.doc = d.doc AND m.citation_id = d.citation_id)")
def unused_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Definitions that nothing refers to."""
    w = corpus._wiki(spark, d)
    return citations.unused_definitions(markdown.markers(w, "doc_id", "text"), markdown.definitions(w, "doc_id", "text")).select("doc", "line_no", "citation_id")


@query(f"WITH {_DEFS}, twice AS (SELECT doc, line_no, citation_id FROM defs UNION ALL SELECT doc, line_no, citation_id FROM defs WHERE line_no % 2 = 0) SELECT doc, citation_id, count(*) AS n FROM twice GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Definitions given more than once: those of even lines stand twice here."""
    defs = markdown.definitions(corpus._wiki(spark, d), "doc_id", "text")
    return citations.repeated_definitions(defs.unionByName(defs.where("line_no % 2 = 0")))


@query(f"""WITH {WIKI}, named AS (SELECT doc_id AS doc, 'wiki/pages/' || lower(regexp_extract(text, '(?s)^---\\n.*?aliases: ?\\[([^,\\]\\n]+)', 1)) || '.md' AS a FROM wiki WHERE regexp_matches(text, '(?s)^---\\n.*?aliases: ?\\[[^,\\]\\n]+')),
declared AS (SELECT doc, regexp_extract(line, '\\]\\(([^()\\s]+)\\): ', 1) AS destination FROM lines WHERE regexp_matches(line, '^- \\[[^\\]]+\\]\\([^()\\s]+\\): .+$')),
edges AS (SELECT DISTINCT a, 'wiki/' || regexp_replace(regexp_replace(destination, '#.*$', ''), '^\\.\\./', '') AS b FROM declared JOIN named USING (doc)), kinds AS (SELECT DISTINCT a AS doc, CASE WHEN length(a) % 2 = 0 THEN 'page' ELSE 'question' END AS kind FROM named)
SELECT * FROM (SELECT a, b, CASE WHEN a = b THEN 'relationship_self' WHEN kind IS NULL THEN 'relationship_target_missing' WHEN kind <> 'page' THEN 'relationship_target_kind_invalid' END AS code FROM edges LEFT JOIN kinds ON doc = b) WHERE code IS NOT NULL
UNION ALL SELECT a, b, 'relationship_not_reciprocal' FROM edges e WHERE a <> b AND NOT EXISTS (SELECT 1 FROM edges r WHERE r.a = e.b AND r.b = e.a)""")
def relation_problems(spark: SparkSession, d: str) -> DataFrame:
    """Declared relations to nothing, to themselves, to a wrong kind (pages of odd names count as questions), or not returned."""
    names = corpus._named_pages(spark, d).select(F.col("doc_id").alias("doc"), F.col("doc").alias("a"))
    edges = graph.resolved(corpus.page_relations(spark, d).select("doc", "destination").join(names, "doc"), corpus.note_path("doc")).select("a", F.col("target").alias("b"))
    kinds = names.select(F.col("a").alias("doc"), F.when(F.length("a") % 2 == 0, "page").otherwise("question").alias("kind")).distinct()
    return graph.relation_problems(edges, kinds, "page")


@query(f"""WITH {FENCED}, named AS (SELECT doc, line_no, line, name FROM outside, (VALUES ('lighthouse journal'), ('parish roll'), ('registrar')) v(name) WHERE NOT regexp_matches(line, '^#{{1,6}} +\\S|^\\[\\^[^\\]\\s]+\\]:')),
placed AS (SELECT doc, line_no, name, length(regexp_extract(line, '^(.*?(?:^|[^\\pL\\pN_]))' || name || '($|[^\\pL\\pN_])', 1)) + 1 AS place FROM named WHERE regexp_matches(line, '(^|[^\\pL\\pN_])' || name || '($|[^\\pL\\pN_])')),
first AS (SELECT doc, line_no, place, name FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no, place, -length(name)) AS i FROM placed) WHERE i = 1),
found AS (SELECT doc, line_no, line, unnest(regexp_extract_all(line, '(\\[[^\\]\\[]*\\]\\([^()\\s]+\\))', 1)) AS link FROM lines WHERE contains(line, '](')), spans AS (SELECT DISTINCT doc, line_no, strpos(line, link) + 1 AS a, strpos(line, link) + strpos(link, '](') - 2 AS b FROM found)
SELECT doc, line_no, place AS "column", name FROM first f WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc = f.doc AND s.line_no = f.line_no AND s.a <= f.place AND f.place + length(f.name) - 1 <= s.b)""")
def unlinked_mentions(spark: SparkSession, d: str) -> DataFrame:
    """First mentions that lie inside no link label."""
    w = corpus._wiki(spark, d)
    first = graph.first_mentions(markdown.running_text(w, "doc_id", "text"), ("lighthouse journal", "parish roll", "registrar"))
    return graph.unlinked_mentions(first, graph.label_spans(markdown.numbered_lines(w, "doc_id", "text"))).select("doc", "line_no", "column", "name")


@query(f"""WITH c AS (SELECT DISTINCT {_key('source_id')} AS source_id FROM citations), s AS (SELECT DISTINCT {_key('source_id')} AS source_id FROM source_records) SELECT source_id FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source_id = c.source_id)""")
def cited_but_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Cited sources that the ledger lacks; null is no source of the ledger."""
    keys = lambda t: table(spark, d, t).select(norm_key("source_id").alias("source_id"))
    return publish.missing_from(keys("citations"), keys("source_records"), ["source_id"])


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 0 THEN 'not_staged' ELSE 'hash_differs' END AS code FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0)""")
def staged_problems(spark: SparkSession, d: str) -> DataFrame:
    """A change set that writes every second document, with some texts not staged and some changed."""
    docs = table(spark, d, "documents").where("text is not null")
    manifest = docs.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 2 == 0, "write").otherwise("delete").alias("operation"), hashing.text_sha256(F.col("text")).alias("sha256"))
    staged = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    return publish.staged_problems(manifest, staged)


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 1 THEN text || 'x' ELSE text END AS text FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0""")
def applied_changes(spark: SparkSession, d: str) -> DataFrame:
    """The documents after a change set: every third is deleted, every next one written anew."""
    docs = table(spark, d, "documents").where("text is not null")
    key = F.col("doc_id").cast("string").alias("path")
    manifest = docs.where("doc_id % 3 < 2").select(key, F.when(F.col("doc_id") % 3 == 0, "delete").otherwise("write").alias("operation"))
    return publish.apply_changes(docs.select(key, "text"), manifest, docs.where("doc_id % 3 = 1").select(key, F.concat("text", F.lit("x")).alias("text")))


@query("SELECT DISTINCT extractor_version AS revision, (SELECT count(DISTINCT extractor_version) FROM extracted_payloads WHERE extractor_version IS NOT NULL)::INT AS n FROM extracted_payloads WHERE extractor_version IS NOT NULL")
def merged_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Reports of more than one revision can't be merged."""
    return evidence.one_revision(table(spark, d, "extracted_payloads").where("extractor_version is not null").select(F.col("extractor_version").alias("revision")))


@query(f"WITH {_LATEST}, {_HELD} SELECT event_id, source_id, prior_sha256 FROM latest l WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.source_id = l.source_id AND h.sha256 = l.prior_sha256)")
def rewrites_unheld(spark: SparkSession, d: str) -> DataFrame:
    """Rewrites that name a content that isn't held."""
    e = _latest(spark, d).select("event_id", "source_id", F.col("prior_sha256").alias("input_sha256"))
    return handoffs.unheld(e, _versions(spark, d)).select("event_id", "source_id", F.col("input_sha256").alias("prior_sha256"))


_INTEGRITY = corpus.ORACLE["citation_integrity"]
_VALIDATION = f"""WITH {_SOURCES}, own AS (SELECT source_id, current_raw_path AS path, byte_size, media_type, state, {_key('active_content_sha256')} AS sha256, {_key('active_derivation_id')} AS derivation_id FROM sources),
described AS (SELECT DISTINCT {_key('source_id')} AS source_id, arg_max(struct_pack(u := url_descriptor.url, d := url_descriptor.description), epoch_us(try_cast(updated_at AS TIMESTAMPTZ))) AS x FROM source_records GROUP BY 1),
live AS (SELECT DISTINCT path, byte_size, media_type, url, description FROM inventory), meeting AS (SELECT coalesce(o.path, l.path) AS path, o.source_id, l.path AS l, o.byte_size, o.media_type, l.byte_size AS lb, l.media_type AS lm, l.url, l.description, x.x.u AS ou, x.x.d AS od FROM own o FULL JOIN live l ON l.path = o.path LEFT JOIN described x ON x.source_id = o.source_id),
{_HELD}, sizes AS (SELECT {_key('source_id')} AS source_id, {_key('sha256')} AS sha256, list(DISTINCT byte_size) AS held_sizes FROM content_versions GROUP BY 1, 2), derived AS (SELECT {_key('derivation_id')} AS derivation_id, list(DISTINCT state) AS qualities FROM extracted_payloads WHERE derivation_id IS NOT NULL GROUP BY 1),
judged AS (SELECT o.*, held_sizes, qualities FROM own o LEFT JOIN sizes z ON z.source_id = o.source_id AND z.sha256 = o.sha256 LEFT JOIN derived d ON d.derivation_id = o.derivation_id),
p AS (SELECT DISTINCT {_key('derivation_id')} AS derivation_id, {_key('source_id')} AS source_id, {_key('content_sha256')} AS sha256, extractor_id, extractor_version FROM extracted_payloads WHERE derivation_id IS NOT NULL),
c AS (SELECT DISTINCT document, citation_id, citation_key, {_key('source_id')} AS source_id, {_key('content_sha256')} AS content_sha256, {_key('derivation_id')} AS derivation_id, anchor_kind, anchor_value FROM citations), i AS ({_INTEGRITY})
SELECT DISTINCT * FROM (
SELECT 'source_missing_from_ledger' AS code, path, coalesce(source_id, '') AS details FROM meeting WHERE source_id IS NULL
UNION ALL SELECT 'ledgered_raw_path_missing', path, coalesce(source_id, '') FROM meeting WHERE l IS NULL
UNION ALL SELECT 'url_descriptor_mismatch', path, source_id FROM meeting WHERE source_id IS NOT NULL AND l IS NOT NULL AND url IS NOT NULL AND (ou IS DISTINCT FROM url OR od IS DISTINCT FROM description)
UNION ALL SELECT 'raw_inventory_metadata_mismatch', path, source_id FROM meeting WHERE source_id IS NOT NULL AND l IS NOT NULL AND url IS NULL AND (byte_size IS DISTINCT FROM lb OR media_type IS DISTINCT FROM lm)
UNION ALL SELECT 'ledger_record_key_mismatch', path, source_id FROM judged WHERE NOT regexp_matches(source_id, '^src_[0-9a-f]{{64}}$')
UNION ALL SELECT 'stale_extracting_state', path, source_id FROM judged WHERE state = 'extracting'
UNION ALL SELECT 'raw_path_role_invalid', path, source_id FROM judged WHERE regexp_matches(path, '^/|(^|/)\\.\\.?(/|$)|\\\\|^_versions/')
UNION ALL SELECT 'active_version_metadata_mismatch', path, source_id FROM judged WHERE held_sizes IS NULL OR NOT coalesce(list_contains(held_sizes, byte_size), false)
UNION ALL SELECT 'active_representation_missing', path, source_id FROM judged WHERE state IN ('ok', 'warning') AND qualities IS NULL
UNION ALL SELECT 'active_quality_state_mismatch', path, source_id FROM judged WHERE state IN ('ok', 'warning') AND NOT list_contains(qualities, state)
UNION ALL SELECT 'duplicate_current_raw_path', path, count(*)::VARCHAR FROM own GROUP BY path HAVING count(*) > 1
UNION ALL SELECT 'duplicate_inventory_path', path, count(*)::VARCHAR FROM inventory GROUP BY path HAVING count(*) > 1
UNION ALL SELECT 'derivation_version_link_invalid', derivation_id, source_id FROM p WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.source_id = p.source_id AND h.sha256 = p.sha256)
UNION ALL SELECT 'derivation_identity_mismatch', derivation_id, source_id FROM p WHERE NOT regexp_matches(derivation_id, '^drv_[0-9a-f]{{64}}$')
UNION ALL SELECT 'derivation_extractor_id_invalid', derivation_id, source_id FROM p WHERE coalesce(extractor_id NOT IN ('pdf', 'image', 'webpage', 'text'), true)
UNION ALL SELECT 'derivation_extractor_version_invalid', derivation_id, source_id FROM p WHERE NOT coalesce(regexp_matches(extractor_version, '\\S'), false)
UNION ALL SELECT 'citation_source_id_invalid', document, citation_key::VARCHAR FROM c WHERE NOT coalesce(regexp_matches(source_id, '^src_[0-9a-f]{{64}}$'), false)
UNION ALL SELECT 'citation_content_sha256_invalid', document, citation_key::VARCHAR FROM c WHERE NOT coalesce(regexp_matches(content_sha256, '^[0-9a-f]{{64}}$'), false)
UNION ALL SELECT 'citation_derivation_id_invalid', document, citation_key::VARCHAR FROM c WHERE NOT coalesce(regexp_matches(derivation_id, '^drv_[0-9a-f]{{64}}$'), false)
UNION ALL SELECT 'citation_anchor_invalid', document, citation_key::VARCHAR FROM c WHERE NOT coalesce(anchor_kind IN ('line', 'page', 'slide', 'sheet', 'section', 'row', 'block') AND regexp_matches(anchor_value, '^[A-Za-z0-9._:/-]+$'), false)
UNION ALL SELECT 'citation_original_stale', document, citation_key::VARCHAR FROM c JOIN own o ON o.source_id = c.source_id WHERE o.sha256 <> c.content_sha256
UNION ALL SELECT 'citation_definition_duplicate', document, citation_id FROM c GROUP BY document, citation_id HAVING count(DISTINCT citation_key) > 1
UNION ALL SELECT i.code, c.document, c.citation_key::VARCHAR FROM i JOIN c ON c.citation_key = i.citation_key WHERE i.code <> 'citation_definition_invalid')"""


@query(_VALIDATION)
def validate(spark: SparkSession, d: str) -> DataFrame:
    """2.L, P14, D20: rules across tables, one row a violation."""
    # one record a source as SQL has it: of equal times the greatest row without its descriptor
    records = corpus._sources(spark, d)
    described = table(spark, d, "source_records").groupBy(norm_key("source_id").alias("source_id")).agg(F.max_by("url_descriptor", instant_us("updated_at")).alias("url_descriptor"))
    return validation.validate(records.drop("url_descriptor").join(described, "source_id"), {t: table(spark, d, t) for t in validation.TABLES}, ("pdf", "image", "webpage", "text"))


@query(f"WITH v AS ({_VALIDATION}) SELECT code, count(*) AS n FROM v GROUP BY 1")
def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    return validate(spark, d).groupBy("code").agg(F.count("*").alias("n"))


ORACLE = SQL
