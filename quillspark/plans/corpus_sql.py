"""SQL that the queries of corpus_queries must agree with."""

from __future__ import annotations

from quillspark.plans.ledger_queries import _key

_ANY = "(contains({c}, 'the registrar') OR contains({c}, 'storage box') OR contains({c}, 'Two of'))"
_LINES = """lines AS (SELECT doc, unnest(generate_series(1, len(l)))::BIGINT AS line_no, unnest(l) AS line FROM (
  SELECT doc_id AS doc, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM {t} WHERE text IS NOT NULL AND text <> ''))"""
LINES = _LINES.format(t="documents")
WIKI = "wiki AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL), " + _LINES.format(t="wiki")
FENCED = WIKI + """, fenced AS (SELECT *, regexp_matches(line, '^ {0,3}(```|~~~)') AS fence, sum(regexp_matches(line, '^ {0,3}(```|~~~)')::INT) OVER (PARTITION BY doc ORDER BY line_no) AS fences FROM lines),
outside AS (SELECT doc, line_no, line FROM fenced WHERE NOT fence AND fences % 2 = 0)"""
HEADS = FENCED + """, heads AS (SELECT doc, line_no, length(regexp_extract(line, '^(#+)', 1))::BIGINT AS level, regexp_extract(line, '^#+ +(.*?)[ \\t\\r]*$', 1) AS title FROM outside WHERE regexp_matches(line, '^#{1,6} +\\S'))"""
HITS = f"hits AS (SELECT * FROM lines WHERE {_ANY.format(c='line')})"
CONTEXT = f"""flagged AS (SELECT *, {_ANY.format(c='line')} AS hit, max({_ANY.format(c='line')}::INT) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lines),
context AS (SELECT doc, line_no, line, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind FROM flagged WHERE near = 1)"""
_MARKED = FENCED + """, bare AS (SELECT doc, line_no, regexp_replace(regexp_replace(line, '`[^`]*`', '', 'g'), '^\\[\\^[^\\]\\s]+\\]:', '') AS line FROM outside),
marks AS (SELECT doc, line_no, unnest(regexp_extract_all(line, '\\[\\^([^\\]\\s]+)\\]', 1)) AS citation_id FROM bare)"""
_SOURCES = f"""sources AS (SELECT r.* FROM (SELECT arg_max(s, (epoch_us(updated_at::TIMESTAMPTZ), s)) AS r FROM (
  SELECT {_key('source_id')} AS k, updated_at, struct_pack(source_id := {_key('source_id')}, schema_version := schema_version, current_raw_path := current_raw_path, previous_raw_paths := previous_raw_paths, media_type := media_type, byte_size := byte_size, state := state, active_content_sha256 := active_content_sha256, active_derivation_id := active_derivation_id, created_at := created_at, inspected_at := inspected_at, updated_at := updated_at) AS s FROM source_records) GROUP BY k))"""
_LINKS = FENCED + """, found AS (SELECT doc, line_no, unnest(regexp_extract_all(regexp_replace(line, '`[^`]*`', '', 'g'), '(\\[[^\\]\\[]*\\]\\([^()\\s]+\\))', 1)) AS link FROM outside),
links AS (SELECT 'wiki/notes/' || doc || '.md' AS doc, line_no, regexp_extract(link, '^\\[([^\\]]*)\\]', 1) AS label, regexp_extract(link, '\\]\\(([^)]*)\\)$', 1) AS destination FROM found)"""
_RULES = f"""rules AS (
  SELECT DISTINCT 'source_id_invalid' AS rule_id, current_raw_path AS path, source_id AS details FROM source_records WHERE NOT regexp_matches({_key('source_id')}, '^src_[0-9a-f]{{64}}$')
  UNION ALL SELECT DISTINCT 'state_invalid', current_raw_path, source_id FROM source_records WHERE state NOT IN ('pending', 'extracting', 'ok', 'warning', 'needs_agent', 'failed', 'unsupported', 'integrity_error', 'awaiting_approval')
  UNION ALL SELECT DISTINCT 'created_at_invalid', current_raw_path, source_id FROM source_records WHERE try_cast(created_at AS TIMESTAMPTZ) IS NULL
  UNION ALL SELECT DISTINCT 'updated_before_created', current_raw_path, source_id FROM source_records WHERE try_cast(updated_at AS TIMESTAMPTZ) < try_cast(created_at AS TIMESTAMPTZ)
  UNION ALL SELECT DISTINCT 'raw_path_role_invalid', current_raw_path, source_id FROM source_records WHERE regexp_matches(current_raw_path, '^/|(^|/)\\.\\.?(/|$)|\\\\')
  UNION ALL SELECT DISTINCT 'active_representation_missing', current_raw_path, source_id FROM source_records WHERE state IN ('ok', 'warning') AND active_derivation_id IS NULL
  UNION ALL SELECT DISTINCT 'stale_extracting_state', current_raw_path, source_id FROM source_records WHERE state = 'extracting'
  UNION ALL SELECT DISTINCT 'version_sha256_invalid', raw_path, source_id FROM content_versions WHERE NOT regexp_matches({_key('sha256')}, '^[0-9a-f]{{64}}$')
  UNION ALL SELECT DISTINCT 'first_seen_at_missing', raw_path, source_id FROM content_versions WHERE try_cast(first_seen_at AS TIMESTAMPTZ) IS NULL
  UNION ALL SELECT DISTINCT 'raw_size_negative', raw_path, source_id FROM content_versions WHERE byte_size < 0
  UNION ALL SELECT DISTINCT 'raw_checksum_missing', path, path FROM inventory WHERE sha256 IS NULL
  UNION ALL SELECT DISTINCT 'derivation_identity_missing', derivation_id, payload_id::VARCHAR FROM extracted_payloads WHERE state IN ('ok', 'warning') AND derivation_id IS NULL
  UNION ALL SELECT DISTINCT 'empty_extraction', derivation_id, payload_id::VARCHAR FROM extracted_payloads WHERE state IN ('ok', 'warning') AND coalesce(length(markdown), 0) = 0)"""
_DECISIONS = "WITH " + _SOURCES + f""",
live AS (SELECT path, r.* FROM (SELECT path, max(struct_pack(byte_size := byte_size, mtime_ns := mtime_ns, sha256 := {_key('sha256')}, url := url)) AS r FROM inventory GROUP BY path)),
ledger AS (SELECT s.source_id, p.path, s.byte_size, {_key('s.active_content_sha256')} AS sha256 FROM (SELECT current_raw_path AS path, min(source_id) AS source_id FROM sources GROUP BY 1) p JOIN sources s ON s.source_id = p.source_id),
matched AS (SELECT l.path, r.source_id, CASE WHEN l.sha256 IS NULL AND l.byte_size IS NOT DISTINCT FROM r.byte_size AND l.mtime_ns IS NULL AND l.url IS NULL THEN 'retain'
  WHEN l.sha256 IS NOT DISTINCT FROM r.sha256 AND l.url IS NULL THEN 'retain' WHEN l.url IS NOT NULL THEN 'process' ELSE 'integrity_error' END AS action FROM live l JOIN ledger r ON l.path = r.path),
fresh AS (SELECT path, CASE WHEN url IS NOT NULL THEN 'url:' || url ELSE 'sha256:' || sha256 END AS key FROM live WHERE path NOT IN (SELECT path FROM ledger WHERE path IS NOT NULL)),
gone AS (SELECT path, source_id, 'sha256:' || sha256 AS key FROM ledger r WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.path = r.path)),
groups AS (SELECT a.key, n_new, n_gone FROM (SELECT key, count(*) AS n_new FROM fresh WHERE key IS NOT NULL GROUP BY 1) a JOIN (SELECT key, count(*) AS n_gone FROM gone WHERE key IS NOT NULL GROUP BY 1) b ON a.key = b.key),
decisions AS (SELECT * FROM matched
  UNION ALL SELECT f.path, g.source_id, 'rename' FROM groups x JOIN fresh f ON f.key = x.key JOIN gone g ON g.key = x.key WHERE n_new = 1 AND n_gone = 1
  UNION ALL SELECT path, NULL, 'create' FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM groups x WHERE x.key = f.key)
  UNION ALL SELECT path, NULL, 'ambiguous' FROM fresh f JOIN groups x ON x.key = f.key WHERE NOT (n_new = 1 AND n_gone = 1)
  UNION ALL SELECT path, source_id, 'missing' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM groups x WHERE x.key = g.key)
  UNION ALL SELECT path, source_id, 'ambiguous' FROM gone g JOIN groups x ON x.key = g.key WHERE NOT (n_new = 1 AND n_gone = 1))
"""
_TOKEN = "(^|[^\\pL\\pN_])({n})($|[^\\pL\\pN_])"


def _filled(values: list[str], column: str, counted: str) -> str:
    rows = ", ".join(f"('{v}')" for v in values)
    return f"SELECT v.{column}, coalesce(c.n, 0)::BIGINT AS n FROM (VALUES {rows}) v({column}) LEFT JOIN (SELECT {column}, count(*) AS n FROM {counted} GROUP BY 1) c ON c.{column} = v.{column}"


ORACLE = {
    "literal_line_search": f"WITH {LINES}, {HITS} SELECT doc, line_no, line FROM hits",
    "search_candidates": f"SELECT doc_id FROM documents WHERE {_ANY.format(c='text')}",
    "search_with_context": f"WITH {LINES}, {CONTEXT} SELECT * FROM context WHERE doc IN (SELECT doc_id FROM documents WHERE {_ANY.format(c='text')})",
    "search_first_term": f"WITH {LINES}, {HITS} SELECT doc, line_no, CASE WHEN contains(line, 'the registrar') THEN 'the registrar' WHEN contains(line, 'storage box') THEN 'storage box' ELSE 'Two of' END AS term FROM hits",
    "search_matched_terms": f"WITH {LINES} SELECT doc, string_agg(term, '|' ORDER BY term) AS terms FROM (SELECT DISTINCT doc, term FROM lines, (VALUES ('the registrar'), ('storage box'), ('Two of')) v(term) WHERE contains(line, term)) GROUP BY doc",
    "first_hit_per_doc": f"WITH {LINES}, {HITS} SELECT doc, min(line_no) AS line_no, arg_min(line, line_no) AS line FROM hits GROUP BY doc",
    "search_pages": f"""WITH {LINES}, {CONTEXT}, numbered AS (SELECT *, row_number() OVER (ORDER BY doc, line_no) AS ordinal FROM context)
SELECT (ordinal - 1) // 200 AS page, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, count(*) AS n,
  sha256(string_agg(doc::VARCHAR || chr(0) || line_no::VARCHAR || chr(0) || kind || chr(0) || line, chr(10) ORDER BY ordinal)) AS digest FROM numbered GROUP BY 1""",
    "search_run_proof": f"WITH {LINES}, {CONTEXT} SELECT greatest(1, (count(*) + 199) // 200)::BIGINT AS n_pages, count(*) AS n_matches, true AS complete FROM context",
    "freshness_probe": "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source",
    "link_candidates": f"""WITH {LINES}, named AS (SELECT doc::VARCHAR AS doc, line_no, line, CASE WHEN regexp_matches(line, '{_TOKEN.format(n='lighthouse journal')}') THEN 'lighthouse journal' WHEN regexp_matches(line, '{_TOKEN.format(n='parish roll')}') THEN 'parish roll' END AS term FROM lines WHERE doc <> 0)
SELECT doc, min(line_no) AS line_no, arg_min(line, line_no) AS line, arg_min(term, line_no) AS term FROM named WHERE term IS NOT NULL GROUP BY doc""",
    "content_ids": """SELECT doc_id, sha256(text) AS sha256, 'src_' || sha256('source-v1' || chr(0) || 'docs/' || doc_id || chr(0) || sha256(text)) AS source_key,
  'drv_' || sha256(sha256(text) || chr(0) || 'text' || chr(0) || '1' || chr(0)) AS derivation_key FROM documents WHERE text IS NOT NULL""",
    "corpus_revision": f"WITH {_SOURCES}, rows_ AS (SELECT source_id || chr(0) || coalesce(active_content_sha256, '') || chr(0) || coalesce(active_derivation_id, '') AS r FROM sources) SELECT sha256(string_agg(r, chr(10) ORDER BY r)) AS revision, count(*) AS n_sources FROM rows_",
    "corpus_revision_tree": f"""WITH {_SOURCES}, rows_ AS (SELECT source_id[5:8] AS b, source_id || chr(0) || coalesce(active_content_sha256, '') || chr(0) || coalesce(active_derivation_id, '') AS r FROM sources),
leaves AS (SELECT b, sha256(string_agg(r, chr(10) ORDER BY r)) AS leaf, count(*) AS n FROM rows_ GROUP BY b), middle AS (SELECT b[1:2] AS c, sha256(string_agg(leaf, chr(10) ORDER BY b)) AS leaf, sum(n) AS n FROM leaves GROUP BY 1)
SELECT sha256(string_agg(leaf, chr(10) ORDER BY c)) AS digest, sum(n)::BIGINT AS n FROM middle""",
    "exact_duplicates": "SELECT sha256, doc_id, n FROM (SELECT doc_id, sha256(text) AS sha256, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1",
    "reconcile_decisions": _DECISIONS + "SELECT path, source_id, action FROM decisions",
    "reconcile_actions": _DECISIONS + _filled(["create", "retain", "process", "rename", "ambiguous", "missing", "integrity_error", "obscured"], "action", "decisions"),
    "state_counts": f"WITH {_SOURCES} " + _filled(["pending", "extracting", "ok", "warning", "needs_agent", "failed", "unsupported", "integrity_error", "awaiting_approval"], "state", "sources"),
    "coverage_gaps": f"""WITH {_SOURCES}, codes AS (SELECT DISTINCT {_key('source_id')} AS source_id, code FROM extracted_payloads WHERE code IS NOT NULL)
SELECT NULL::VARCHAR AS source_id, 'raw_file_unavailable' AS code, path FROM (SELECT DISTINCT path FROM inventory WHERE sha256 IS NULL)
UNION ALL SELECT s.source_id, coalesce(c.code, 'source_' || s.state), s.current_raw_path FROM sources s LEFT JOIN codes c ON c.source_id = s.source_id WHERE s.state IN ('pending', 'warning', 'needs_agent', 'failed', 'unsupported', 'integrity_error', 'awaiting_approval')""",
    "adoption_chain_breaks": f"""WITH {_SOURCES}, latest AS (SELECT event_id, arg_max(struct_pack(s := {_key('source_id')}, p := {_key('prior_sha256')}, a := {_key('adopted_sha256')}, t := epoch_us(recorded_at::TIMESTAMPTZ)), delivered_at) AS e FROM adoption_events GROUP BY 1),
ev AS (SELECT event_id, e.s AS source_id, e.p AS p, e.a AS a, e.t AS t FROM latest),
held AS (SELECT {_key('source_id')} AS source_id, {_key('sha256')} AS sha256, min(epoch_us(try_cast(first_seen_at AS TIMESTAMPTZ))) AS us FROM content_versions GROUP BY 1, 2),
chain AS (SELECT ev.*, hp.us AS prior_us, ha.us AS adopted_us, hp.sha256 AS hp, ha.sha256 AS ha, row_number() OVER (PARTITION BY ev.source_id, a ORDER BY t, event_id) > 1 AS again, first(p) OVER w AS root, lag(a) OVER w AS before, coalesce(lag(t) OVER w, hp.us) AS before_us
  FROM ev LEFT JOIN held hp ON hp.source_id = ev.source_id AND hp.sha256 = p LEFT JOIN held ha ON ha.source_id = ev.source_id AND ha.sha256 = a WINDOW w AS (PARTITION BY ev.source_id ORDER BY t, event_id)),
ends AS (SELECT source_id, arg_max(a, (t, event_id)) AS last, arg_min(p, (t, event_id)) AS root FROM ev GROUP BY 1),
members AS (SELECT source_id, a AS sha256 FROM ev UNION SELECT source_id, root FROM ends), alone AS (SELECT source_id, count(*) AS n, min(sha256) AS only FROM held GROUP BY 1)
SELECT * FROM (SELECT source_id, event_id, CASE WHEN before IS NULL AND prior_us IS NULL THEN 'root_not_held' WHEN before <> p THEN 'prior_mismatch' WHEN again OR a = root THEN 'adopted_again' WHEN adopted_us IS NULL THEN 'adopted_not_held'
  WHEN prior_us IS NULL THEN 'prior_not_held' WHEN t < before_us THEN 'not_later' WHEN adopted_us <> t THEN 'first_seen_differs' END AS problem FROM chain) WHERE problem IS NOT NULL
UNION ALL SELECT DISTINCT h.source_id, NULL::BIGINT, 'held_outside_chain' FROM held h LEFT JOIN members m ON m.source_id = h.source_id AND m.sha256 = h.sha256 JOIN alone a ON a.source_id = h.source_id LEFT JOIN ends e ON e.source_id = h.source_id WHERE m.sha256 IS NULL AND (e.last IS NOT NULL OR a.n > 1)
UNION ALL SELECT DISTINCT s.source_id, NULL::BIGINT, 'active_not_last' FROM sources s LEFT JOIN ends e ON e.source_id = s.source_id LEFT JOIN alone a ON a.source_id = s.source_id WHERE {_key('s.active_content_sha256')} IS DISTINCT FROM coalesce(e.last, a.only)""",
    "page_headings": f"WITH {HEADS} SELECT * FROM heads",
    "section_extents": f"WITH {HEADS} SELECT h.doc, h.line_no, h.level, coalesce(min(n.line_no) - 1, -1)::BIGINT AS end_line FROM heads h LEFT JOIN heads n ON n.doc = h.doc AND n.line_no > h.line_no AND n.level <= h.level GROUP BY 1, 2, 3",
    "skipped_levels": f"WITH {HEADS} SELECT doc, line_no, level FROM (SELECT *, coalesce(lag(level) OVER (PARTITION BY doc ORDER BY line_no), 0) AS before FROM heads) WHERE level > before + 1",
    "page_frontmatter": f"""WITH {WIKI}, front AS (SELECT doc_id, chr(10) || regexp_extract(text, '(?s)^---\\n(.*?)\\n---(\\n|$)', 1) || chr(10) AS f FROM wiki WHERE regexp_matches(text, '(?s)^---\\n.*?\\n---(\\n|$)'))
SELECT doc_id, regexp_extract(f, '\\nid: ?([^\\n]*)', 1) AS id, regexp_extract(f, '\\ntitle: ?([^\\n]*)', 1) AS title, regexp_extract(f, '\\ntype: ?([^\\n]*)', 1) AS type FROM front""",
    "citation_markers": f"WITH {_MARKED} SELECT doc, citation_id, count(*) AS n FROM marks GROUP BY ALL",
    "undefined_markers": f"WITH {_MARKED}, defs AS (SELECT DISTINCT doc, regexp_extract(line, '^\\[\\^([^\\]\\s]+)\\]:', 1) AS citation_id FROM outside WHERE regexp_matches(line, '^\\[\\^([^\\]\\s]+)\\]:')) SELECT DISTINCT doc, line_no, citation_id FROM marks m WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.doc = m.doc AND d.citation_id = m.citation_id)",
    "page_links": f"WITH {_LINKS} SELECT doc, line_no, label, destination FROM links",
    "link_targets_missing": f"""WITH {_LINKS}, named AS (SELECT DISTINCT 'wiki/pages/' || lower(regexp_extract(text, '(?s)^---\\n.*?aliases: ?\\[([^,\\]\\n]+)', 1)) || '.md' AS doc FROM wiki WHERE regexp_matches(text, '(?s)^---\\n.*?aliases: ?\\[[^,\\]\\n]+')),
placed AS (SELECT *, 'wiki/' || regexp_replace(regexp_replace(destination, '#.*$', ''), '^\\.\\./', '') AS target FROM links)
SELECT doc, line_no, destination, CASE WHEN target = doc THEN 'link_self' WHEN target NOT IN (SELECT doc FROM named) THEN 'link_target_missing' ELSE 'link_fragment_invalid' END AS code FROM placed WHERE target = doc OR target NOT IN (SELECT doc FROM named) OR contains(destination, '#')""",
    "reciprocity_violations": f"""WITH edges AS (SELECT DISTINCT {_key('prior_sha256')} AS a, {_key('adopted_sha256')} AS b FROM adoption_events WHERE prior_sha256 IS NOT NULL AND adopted_sha256 IS NOT NULL)
SELECT a, b FROM edges e WHERE a <> b AND NOT EXISTS (SELECT 1 FROM edges r WHERE r.a = e.b AND r.b = e.a)""",
    "page_reciprocity": f"""WITH {WIKI}, named AS (SELECT doc_id AS doc, 'wiki/pages/' || lower(regexp_extract(text, '(?s)^---\\n.*?aliases: ?\\[([^,\\]\\n]+)', 1)) || '.md' AS a FROM wiki WHERE regexp_matches(text, '(?s)^---\\n.*?aliases: ?\\[[^,\\]\\n]+')),
declared AS (SELECT doc, regexp_extract(line, '\\]\\(([^()\\s]+)\\): ', 1) AS destination FROM lines WHERE regexp_matches(line, '^- \\[[^\\]]+\\]\\([^()\\s]+\\): .+$')),
edges AS (SELECT DISTINCT a, 'wiki/' || regexp_replace(regexp_replace(destination, '#.*$', ''), '^\\.\\./', '') AS b FROM declared JOIN named USING (doc))
SELECT a, b FROM edges e WHERE a <> b AND NOT EXISTS (SELECT 1 FROM edges r WHERE r.a = e.b AND r.b = e.a)""",
    "ambiguous_names": f"WITH {HEADS} SELECT lower(title) AS name, count(DISTINCT doc) AS n_docs FROM heads WHERE level = 1 GROUP BY 1 HAVING count(DISTINCT doc) > 1",
    "wiki_index": f"""WITH {HEADS}, titles AS (SELECT doc::VARCHAR || '.md' AS path, arg_min(title, line_no) AS title FROM heads WHERE level = 1 GROUP BY doc)
SELECT ends_with(title, '?')::INT AS part, path, '- [' || regexp_replace(title, '([\\\\\\[\\]])', '\\\\\\1', 'g') || '](' || path || ')' AS line FROM titles""",
    "extractor_choice": """SELECT DISTINCT path, CASE WHEN media_type = 'application/pdf' THEN 'pdf' WHEN media_type IN ('image/png', 'image/tiff', 'image/jpeg') THEN 'image' WHEN media_type = 'text/plain' THEN 'text'
  WHEN lower(path) LIKE '%.url.md' THEN 'webpage' WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(path), '\\.(png|tiff|jpg)$') THEN 'image' WHEN regexp_matches(lower(path), '\\.(txt|md)$') THEN 'text' END AS extractor_id FROM inventory""",
    "canonical_urls": """WITH parts AS (SELECT capture_id, final_url, lower(regexp_extract(final_url, '(?i)^(https?)://', 1)) AS s, regexp_extract(final_url, '(?i)^https?://([^/?#]*)', 1) AS n, regexp_extract(final_url, '(?i)^https?://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(final_url, '(?i)^https?://[^/?#]*[^?#]*(\\?[^#]*)', 1) AS q FROM rendered_captures),
named AS (SELECT *, lower(regexp_extract(n, '^([^:]*)', 1)) AS h, CASE WHEN s = 'https' THEN 443 ELSE 80 END AS standard, try_cast(nullif(regexp_extract(n, ':([0-9]+)$', 1), '') AS INT) AS port FROM parts)
SELECT DISTINCT capture_id, CASE WHEN s <> '' AND NOT regexp_matches(final_url, '[\\s[:cntrl:]]') AND regexp_matches(n, '^[A-Za-z0-9.-]+(:[0-9]+)?$') AND regexp_matches(h, '^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*\\.*$') AND length(h) <= 253 AND coalesce(port, standard) BETWEEN 1 AND 65535
  THEN s || '://' || h || CASE WHEN coalesce(port, standard) = standard THEN '' ELSE ':' || port END || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '?' THEN '' ELSE q END END AS url FROM named""",
    "md_table": """WITH r AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation)
SELECT n_regionkey, '| Column 1 | Column 2 | Source row |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' | <a id="row:' || i || '"></a> |', chr(10) ORDER BY i) || chr(10) AS markdown FROM r GROUP BY 1""",
    "json_blocks": """SELECT event_id, '{"k":' || (props->>'$.k') || '}' AS canonical FROM events""",
    "citation_integrity": f"""WITH c AS (SELECT DISTINCT citation_key, {_key('source_id')} AS s, {_key('content_sha256')} AS h, {_key('derivation_id')} AS d, anchor_kind AS k, anchor_value AS v FROM citations),
src AS (SELECT DISTINCT {_key('source_id')} AS s FROM source_records), ver AS (SELECT DISTINCT {_key('source_id')} AS s, {_key('sha256')} AS h FROM content_versions),
p AS (SELECT {_key('derivation_id')} AS d, {_key('source_id')} AS s, {_key('content_sha256')} AS h, anchors FROM extracted_payloads WHERE derivation_id IS NOT NULL), own AS (SELECT DISTINCT d, s, h FROM p),
anc AS (SELECT DISTINCT d, a.kind AS k, a.value AS v FROM (SELECT d, unnest(anchors) AS a FROM p))
SELECT * FROM (SELECT citation_key, CASE WHEN c.s IS NULL OR c.h IS NULL OR c.d IS NULL THEN 'citation_definition_invalid' WHEN src.s IS NULL THEN 'citation_source_missing' WHEN ver.s IS NULL THEN 'citation_version_missing'
  WHEN own.d IS NULL THEN 'citation_derivation_missing' WHEN anc.d IS NULL THEN 'citation_anchor_missing' END AS code FROM c LEFT JOIN src ON src.s = c.s LEFT JOIN ver ON ver.s = c.s AND ver.h = c.h
  LEFT JOIN own ON own.d = c.d AND own.s = c.s AND own.h = c.h LEFT JOIN anc ON anc.d = c.d AND anc.k = c.k AND anc.v = c.v) WHERE code IS NOT NULL""",
    "line_anchors": """WITH l AS (SELECT doc_id AS doc, regexp_split_to_array(regexp_replace(text, '(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}])$', ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS lines FROM documents WHERE text <> '')
SELECT doc, len(lines)::BIGINT AS n_lines, list_max(list_transform(lines, lambda x: length(x)))::BIGINT AS longest FROM l""",
    "anchor_problems": """WITH p AS (SELECT payload_id AS key, list_transform(regexp_extract_all(markdown, '<a id="([a-z]+:[^"]*)"></a>', 1), lambda x: x) AS found, list_transform(coalesce(anchors, []), lambda a: a.kind || ':' || a.value) AS declared FROM extracted_payloads WHERE markdown IS NOT NULL)
SELECT DISTINCT * FROM (SELECT key, CASE WHEN len(list_distinct(declared)) < len(declared) THEN 'declared_twice' WHEN len(list_distinct(found)) < len(found) THEN 'marked_twice'
  WHEN len(list_filter(declared, lambda x: NOT list_contains(found, x))) > 0 THEN 'not_marked' WHEN len(list_filter(found, lambda x: NOT list_contains(declared, x))) > 0 THEN 'not_declared' END AS problem FROM p) WHERE problem IS NOT NULL""",
    "bounded_sample": """WITH RECURSIVE top AS (SELECT doc_id, n_chars, i FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE n_chars IS NOT NULL) WHERE i <= 100),
walk AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, NULL::BIGINT AS doc_id, NULL::BIGINT AS n_chars, false AS kept
  UNION ALL SELECT t.i, CASE WHEN w.used + t.n_chars <= 32768 THEN w.used + t.n_chars ELSE w.used END, t.doc_id, t.n_chars, w.used + t.n_chars <= 32768 FROM walk w JOIN top t ON t.i = w.i + 1)
SELECT doc_id, n_chars, (SELECT count(*) FROM documents WHERE n_chars IS NOT NULL) AS total FROM walk WHERE kept""",
    "first_mentions": f"""WITH {FENCED}, named AS (SELECT doc, line_no, line, name FROM outside, (VALUES ('lighthouse journal'), ('journal'), ('parish roll')) v(name) WHERE NOT regexp_matches(line, '^#{{1,6}} +\\S|^\\[\\^[^\\]\\s]+\\]:')),
placed AS (SELECT doc, line_no, name, length(regexp_extract(line, '^(.*?(?:^|[^\\pL\\pN_]))' || name || '($|[^\\pL\\pN_])', 1)) + 1 AS place FROM named WHERE regexp_matches(line, '(^|[^\\pL\\pN_])' || name || '($|[^\\pL\\pN_])'))
SELECT doc, line_no, place AS "column", name FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no, place, -length(name)) AS i FROM placed) WHERE i = 1""",
    "path_parts": """SELECT DISTINCT path, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.](\\.[^.]+)$', 1)) AS suffix, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent,
  (SELECT CASE WHEN regexp_matches(n, '^.+\\.[^.]+$') THEN n ELSE n || coalesce(MAP {'text/plain': '.txt', 'application/pdf': '.pdf', 'image/png': '.png', 'image/jpeg': '.jpg', 'image/tiff': '.tiff', 'text/html': '.html', 'text/markdown': '.md', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document': '.docx'}[media_type], '.bin') END
    FROM (SELECT coalesce(nullif(left(trim(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '-', 'g'), '-.'), 120), ''), 'snapshot') AS n)) AS safe,
  NOT (regexp_matches(path, '(^|/)(\\.|\\.\\.)?(/|$)') OR contains(path, chr(92)) OR regexp_matches(path, '[[:cntrl:]]')) AS relative FROM inventory""",
    "strict_instants": """SELECT DISTINCT source_id, created_at, CASE WHEN regexp_matches(created_at, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d{6})?Z$') THEN epoch_us(try_cast(created_at AS TIMESTAMPTZ)) END AS created_us FROM source_records""",
    "page_relations": f"""WITH {WIKI} SELECT doc, line_no, regexp_extract(line, '^- \\[([^\\]]+)\\]', 1) AS label, regexp_extract(line, '\\]\\(([^()\\s]+)\\): ', 1) AS destination, regexp_extract(line, '\\): (.+)$', 1) AS note FROM lines WHERE regexp_matches(line, '^- \\[[^\\]]+\\]\\([^()\\s]+\\): .+$')""",
    "label_spans": f"""WITH {WIKI}, found AS (SELECT doc, line_no, line, unnest(regexp_extract_all(line, '(\\[[^\\]\\[]*\\]\\([^()\\s]+\\))', 1)) AS link FROM lines WHERE contains(line, ']('))
SELECT DISTINCT doc, line_no, strpos(line, link) + 1 AS from_column, strpos(line, link) + strpos(link, '](') - 2 AS to_column FROM found""",
    "retained_versions": f"""SELECT source_id, count(*) AS n_versions, sum(byte_size)::BIGINT AS total_bytes FROM (SELECT {_key('source_id')} AS source_id, {_key('sha256')} AS sha256, max(byte_size) AS byte_size FROM content_versions GROUP BY 1, 2) GROUP BY 1""",
    "hashed_twice": f"""SELECT sha256, path, n FROM (SELECT *, count(*) OVER (PARTITION BY sha256) AS n FROM (SELECT DISTINCT path, {_key('sha256')} AS sha256 FROM inventory WHERE sha256 IS NOT NULL)) WHERE n > 1""",
    "conflicting_evidence": f"""SELECT document, count(*) AS n_identities FROM (SELECT DISTINCT document, {_key('source_id')} AS a, {_key('content_sha256')} AS b, {_key('derivation_id')} AS c, anchor_kind, anchor_value FROM citations WHERE document IS NOT NULL) GROUP BY 1 HAVING count(*) >= 2""",
    "evidence_packet": f"WITH {LINES} SELECT true AS valid, 'r1' AS revision, count(DISTINCT (doc, line_no)) AS n_evidence FROM lines WHERE {_ANY.format(c='line')}",
    "reference_problems": """WITH c AS (SELECT DISTINCT document, citation_id, anchor_kind FROM citations WHERE citation_id IS NOT NULL), s AS (SELECT DISTINCT document, citation_id FROM c WHERE anchor_kind = 'page'), o AS (SELECT DISTINCT document, citation_id FROM c WHERE anchor_kind = 'line'), k AS (SELECT DISTINCT document, citation_id FROM c WHERE anchor_kind <> 'page')
SELECT document, citation_id, 'support_and_counter' AS code FROM s JOIN o USING (document, citation_id) UNION ALL SELECT document, citation_id, 'unknown_citation' FROM (SELECT * FROM s UNION SELECT * FROM o) x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.document = x.document AND k.citation_id = x.citation_id)""",
    "event_sequence_check": "SELECT user_id, before, event_id AS after FROM (SELECT user_id, event_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0)::BIGINT AS before FROM events) WHERE event_id - before <> 1",
    "event_kind_counts": _filled(["click", "view", "purchase", "signup", "error", "refund"], "event_type", "events"),
    "event_digest": """WITH leaves AS (SELECT event_type, event_id // 1000 AS b, count(*) AS n, sha256(string_agg(lpad(event_id::VARCHAR, 20, '0') || chr(0) || props, chr(10) ORDER BY event_id)) AS leaf FROM events WHERE props IS NOT NULL GROUP BY 1, 2),
middle AS (SELECT event_type, b // 1000 AS c, sum(n) AS n, sha256(string_agg(leaf, chr(10) ORDER BY b)) AS leaf FROM leaves GROUP BY 1, 2)
SELECT event_type, sha256(string_agg(leaf, chr(10) ORDER BY c)) AS digest, sum(n)::BIGINT AS n FROM middle GROUP BY 1""",
    "postimage_diff": """WITH b AS (SELECT doc_id, text, true AS i FROM documents), a AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 1000000000 ELSE 0 END AS doc_id, CASE WHEN doc_id % 7 = 0 THEN upper(text) ELSE text END AS text, true AS i FROM documents)
SELECT * FROM (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.i IS NULL THEN 'added' WHEN a.i IS NULL THEN 'removed' WHEN b.text IS DISTINCT FROM a.text THEN 'changed' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id) WHERE change IS NOT NULL""",
    "dropped_markers": f"WITH {_MARKED} SELECT doc, count(*) AS n_dropped FROM marks WHERE doc % 3 = 0 GROUP BY doc",
    "quality_report": f"WITH {_RULES} SELECT rule_id, count(*) AS n FROM rules GROUP BY 1",
    "quality_rows": f"WITH {_RULES} SELECT * FROM rules",
    "status_rollup": f"WITH {_SOURCES}, {_RULES} SELECT 'state' AS what, state AS name, count(*) AS n FROM sources GROUP BY state UNION ALL SELECT 'inventory', 'paths', count(DISTINCT path) FROM inventory UNION ALL SELECT 'rule', rule_id, count(*) FROM rules GROUP BY rule_id",
    "ocr_accepted": """SELECT DISTINCT payload_id, length(regexp_replace(markdown, '[^\\pL\\pN]', '', 'g')) >= 10 AND len(list_filter(regexp_split_to_array(markdown, '[ \\t\\n\\r\\f\\v]+'), lambda t: t <> '')) >= 3 AS accepted FROM extracted_payloads WHERE extractor_id IN ('pdf', 'image') AND markdown IS NOT NULL""",
}
