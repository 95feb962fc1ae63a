"""Comparison SQL: sources, upkeep, reports, review, scope, evaluation, streams, scorers."""

from __future__ import annotations

from attestry import lexicons as lx
from attestry.operators import claims as cl
from verification import inputs as vi
from verification.sql.base import SPACES, lit, oracle, part, strip
from verification.sql.s_claims import named, rank
from verification.sql.s_retrieval import and_match
from verification.sql.s_structure import line_list
from verification.sql.s_text import expansion_rows, overlap_terms

US = "::BIGINT * 1000000"
HEAD = f"coalesce(nullif({strip(f'''ltrim(list_filter(list_transform({line_list('content')}, lambda x: {strip('x')}), lambda x: starts_with(x, '#'))[1], '#')''')}, ''), STEM)"


def head(stem: str) -> str:
    return HEAD.replace("STEM", stem)


DOC_ID = lambda t: f"replace(lower({t}), ' ', '_')"

# ------------------------------------------------------------------ A
oracle(
    "read_documents",
    f"""WITH raw AS (SELECT *, n % 5 = 0 AS j, n % 35 = 0 AS bad, 'File ' || n AS stem FROM docs),
    named_docs AS (SELECT *, CASE WHEN bad THEN stem WHEN j THEN 'Title ' || n ELSE {head('stem')} END AS title FROM raw),
    full_docs AS (SELECT *, CASE WHEN bad THEN '# ' || title || chr(10) || chr(10) WHEN j THEN '# ' || title || chr(10) || chr(10) || content ELSE content END AS body, CASE WHEN j AND NOT bad AND n % 10 = 0 THEN '2 nd' END AS ed FROM named_docs)
    SELECT knowledge_base_id || '/' || stem || CASE WHEN j THEN '.json' ELSE '.md' END AS source_path, {DOC_ID('title')} || '_' || replace(coalesce(ed, 'default'), ' ', '_') AS doc_uid, {DOC_ID('title')} AS doc_id, title AS doc_title,
    ed AS edition, CASE WHEN j AND NOT bad THEN author END AS author, CASE WHEN j AND NOT bad AND n % 3 = 0 THEN knowledge_base_id END AS source_name, CASE WHEN j AND NOT bad THEN 'a|b|c' ELSE '' END AS tags,
    sha256(body) AS source_hash, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS ingest_status FROM full_docs""",
)
oracle(
    "extract_metadata",
    f"SELECT source_path AS path, t AS doc_title, {DOC_ID('t')} AS doc_id, {DOC_ID('t')} || '_default' AS doc_uid FROM (SELECT source_path, {head(chr(39) + 'doc_' + chr(39) + ' || n')} AS t FROM docs)",
)
oracle("fingerprint_documents", "SELECT doc_uid, sha256(content) AS source_hash FROM docs")
oracle(
    "detect_changes",
    """SELECT source_path, CASE WHEN n % 9 = 0 THEN 'missing' WHEN n % 10 = 0 THEN 'new' WHEN n % 7 = 0 THEN 'changed' WHEN n % 11 = 0 THEN 'moved' ELSE 'skipped' END AS change FROM docs WHERE n % 9 <> 0 OR n % 10 <> 0""",
)
part(
    "reconciled",
    """SELECT source_path, n % 10 <> 0 AS is_registered, n % 9 <> 0 AS source_exists, CASE WHEN n % 10 <> 0 THEN index_status ELSE 'not_registered' END AS index_status,
    n % 10 <> 0 AND index_status <> 'indexed' AS needs_rebuild, CASE WHEN n % 10 <> 0 AND index_status <> 'indexed' THEN '建议重建' WHEN n % 10 <> 0 THEN '已就绪' ELSE '可注册' END AS action_hint
    FROM docs WHERE n % 9 <> 0 OR n % 10 <> 0""",
)
oracle("reconcile_scan", "SELECT * FROM reconciled")
oracle(
    "scan_totals",
    """SELECT count(*) FILTER (source_exists) AS total_files, count(*) FILTER (is_registered) AS registered_files, count(*) FILTER (NOT is_registered AND source_exists) AS pending_register_files,
    count(*) FILTER (needs_rebuild) AS needs_rebuild_files FROM reconciled""",
)
oracle(
    "upsert_documents",
    f"""SELECT doc_uid, knowledge_base_id, CASE WHEN n % 2 = 0 THEN doc_title || ' again' ELSE doc_title END AS doc_title, (created_s + CASE WHEN n % 3 = 0 THEN 3600 ELSE 0 END){US} AS created_at,
    (updated_s + CASE WHEN n % 2 = 0 THEN 3600 ELSE 0 END){US} AS updated_at FROM docs WHERE n % 3 <> 0 OR n % 2 = 0""",
)
oracle(
    "replace_derived_rows",
    """SELECT doc_uid, chunk_index, token_count FROM chunks WHERE substr(doc_uid, 2)::INT % 4 <> 0 UNION ALL SELECT doc_uid, 0::BIGINT, 1::BIGINT FROM docs WHERE n % 4 = 0""",
)
oracle(
    "rebuild_documents",
    """SELECT d.doc_uid, s.k AS sections, c.k AS chunks, c.k AS vectors FROM docs d JOIN (SELECT doc_uid, count(*) AS k FROM sections GROUP BY doc_uid) s USING (doc_uid)
    JOIN (SELECT doc_uid, count(*) AS k FROM chunks GROUP BY doc_uid) c USING (doc_uid) WHERE d.index_status <> 'indexed'""",
)
oracle("reassign_knowledge_base", "SELECT doc_uid, CASE WHEN n % 6 = 0 THEN 'moved' ELSE knowledge_base_id END AS knowledge_base_id FROM docs")
part("review_claims", "SELECT user_id AS claim_id, user_id // 10 AS check_id, user_id % 10 AS claim_no, 'claim of user ' || user_id AS claim_text, min(ts) AS created_at, (count(*) % 5) AS evidence_count, CASE user_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'needs_review' ELSE 'rejected' END AS verdict, CASE user_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level FROM events GROUP BY user_id")
part("review_checks", "SELECT check_id, 'src' || (check_id % 20) AS knowledge_base_id, min(created_at) AS created_at FROM review_claims GROUP BY check_id")
part("review_rows", "SELECT event_id AS review_id, user_id AS claim_id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'updated' END AS review_action, ts AS created_at FROM events WHERE event_type IN ('purchase', 'error', 'click')")
oracle(
    "cascade_delete",
    """SELECT 'checks' AS table_name, check_id AS id FROM review_checks WHERE check_id % 2 <> 0 UNION ALL SELECT 'claims', claim_id FROM review_claims WHERE check_id % 2 <> 0
    UNION ALL SELECT 'reviews', review_id FROM review_rows WHERE (claim_id // 10) % 2 <> 0""",
)
part("bases", "SELECT DISTINCT source || e AS knowledge_base_id, source || e = 'src1-empty' AS is_default, regexp_extract(source, '([0-9]+)', 1)::INT AS num, e = '' AS plain FROM documents, (VALUES (''), ('-empty')) AS t(e)")
oracle(
    "guard_kb_delete",
    """SELECT b.knowledge_base_id, b.is_default, coalesce(d.k, 0) AS document_count, coalesce(c.k, 0) AS quality_check_count, coalesce(m.k, 0) AS claim_count, coalesce(r.k, 0) AS review_count,
    NOT b.is_default AND coalesce(d.k, 0) + coalesce(c.k, 0) + coalesce(m.k, 0) + coalesce(r.k, 0) = 0 AS deletable FROM bases b
    LEFT JOIN (SELECT source AS kb, count(*) AS k FROM documents GROUP BY 1) d ON d.kb = b.knowledge_base_id
    LEFT JOIN (SELECT knowledge_base_id AS kb, count(*) AS k FROM review_checks GROUP BY 1) c ON c.kb = b.knowledge_base_id
    LEFT JOIN (SELECT 'src' || (check_id % 20) AS kb, count(*) AS k FROM review_claims GROUP BY 1) m ON m.kb = b.knowledge_base_id
    LEFT JOIN (SELECT 'src' || ((claim_id // 10) % 20) AS kb, count(*) AS k FROM review_rows GROUP BY 1) r ON r.kb = b.knowledge_base_id""",
)
oracle(
    "set_default_kb",
    f"""SELECT knowledge_base_id, CASE WHEN plain AND num % 2 = 0 THEN upper('base ' || knowledge_base_id) ELSE 'base ' || knowledge_base_id END AS name,
    knowledge_base_id = (SELECT max_by(knowledge_base_id, num) FROM bases WHERE plain AND num % 2 = 0 AND num >= 10) AS is_default, ({vi.EPOCH} + num * 60){US} AS created_at, ({vi.EPOCH} + num * 61){US} AS updated_at FROM bases""",
)
oracle(
    "delete_reviews",
    """SELECT r.review_id, r.claim_id, r.review_action, coalesce(n.status, 'pending') AS restored_review_status FROM review_rows r
    LEFT JOIN (SELECT claim_id, max_by(review_action, {'c': created_at, 'i': review_id}) AS status FROM review_rows WHERE review_action <> 'approved' GROUP BY claim_id) n USING (claim_id)
    WHERE r.review_action = 'approved'""",
)
oracle(
    "kb_listing",
    "SELECT row_number() OVER (ORDER BY is_default DESC, num DESC, 'base ' || knowledge_base_id) AS place, knowledge_base_id FROM bases",
)
oracle("kb_lookup", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN source ELSE 'src1-empty' END AS knowledge_base_id FROM documents")
oracle(
    "normalize_kb_id",
    f"""SELECT conv_id, turn, k AS kb_id, k IS NOT NULL AS valid FROM (SELECT conv_id, turn, nullif(trim(regexp_replace(regexp_replace({strip("' _' || regexp_replace(text, '[a-m]', '.', 'g')")}, '[^0-9A-Za-z_\\-一-{chr(0x9fff)}]+', '_', 'g'), '_+', '_', 'g'), '_'), '') AS k FROM conversations)""",
)
oracle("backfill_columns", "SELECT doc_uid, CASE WHEN n % 8 IN (0, 1) THEN 'default' ELSE knowledge_base_id END AS knowledge_base_id, 'active' AS status, 0::BIGINT AS page_no FROM docs")
oracle(
    "append_job_log",
    f"""SELECT sha256(doc_uid || ':' || stage) AS job_id, doc_uid, stage, ingest_status AS status, updated_s{US} AS finished_at FROM docs, (VALUES ('ingest'), ('index')) AS t(stage) WHERE stage = 'ingest' OR index_status = 'indexed'""",
)
oracle("load_eval_cases", "SELECT item_id::VARCHAR AS case_id, text AS query, 'd' AS expected_doc_uids FROM benchmark")
oracle(
    "load_rules",
    """SELECT row_number() OVER (ORDER BY source) AS rule_no, source AS code, 'rule ' || source AS name, array_to_string(list_sort(list(DISTINCT lang)), '|') AS keywords, 'warn' AS hit_level, 'm' AS message FROM documents GROUP BY source""",
)
oracle(
    "load_term_dictionary",
    """WITH pairs AS (SELECT DISTINCT lang, source FROM documents), last_lang AS (SELECT source, max(lang) AS lang FROM pairs GROUP BY source)
    SELECT 'aa' AS alias, 'b' AS canonical, 'variant' AS kind UNION ALL SELECT lang, lang, 'alias' FROM (SELECT DISTINCT lang FROM pairs) UNION ALL SELECT source, lang, 'alias' FROM last_lang""",
)
oracle(
    "write_check_result",
    """SELECT d.check_id, d.claim_id, d.verdict, 'run-1' AS run_id, o.v AS overall_verdict FROM decided d JOIN (SELECT check_id, CASE WHEN bool_or(verdict = 'rejected') THEN 'rejected' WHEN bool_and(verdict = 'verified') THEN 'passed' ELSE 'needs_review' END AS v
    FROM decided GROUP BY check_id) o USING (check_id)""",
)

# ------------------------------------------------------------------ G
part(
    "metrics",
    """SELECT d.doc_uid, d.doc_title, d.source_path, d.ingest_status, d.index_status, coalesce(s.k, 0) AS section_count, coalesce(c.k, 0) AS chunk_count, coalesce(c.k, 0) AS fts_chunk_count, coalesce(c.lo, 0) AS min_chunk_chars, coalesce(c.hi, 0) AS max_chunk_chars,
    coalesce(c.total, 0)::BIGINT AS total_chunk_chars, coalesce(round(c.total::DOUBLE / c.k, 1), 0) AS avg_chunk_chars, coalesce(round(c.k::DOUBLE / s.k, 1), 0) AS avg_chunks_per_section, CASE WHEN d.n % 10 = 0 THEN 0 ELSE coalesce(c.k, 0) END AS vector_chunk_count
    FROM docs d LEFT JOIN (SELECT doc_uid, count(*) AS k FROM sections GROUP BY doc_uid) s USING (doc_uid)
    LEFT JOIN (SELECT doc_uid, count(*) AS k, min(token_count) AS lo, max(token_count) AS hi, sum(token_count) AS total FROM chunks GROUP BY doc_uid) c USING (doc_uid)""",
)
oracle(
    "document_metrics",
    "SELECT doc_uid, section_count, chunk_count, fts_chunk_count, min_chunk_chars, max_chunk_chars, total_chunk_chars, avg_chunk_chars, avg_chunks_per_section FROM metrics",
)
oracle(
    "sample_rows",
    """SELECT c.doc_uid, c.chunk_index, c.chunk_id FROM chunks c JOIN (SELECT doc_uid, max(chunk_index) AS m FROM chunks GROUP BY doc_uid) t USING (doc_uid)
    WHERE m < 4 OR c.chunk_index IN (0, round_even(m / 3.0, 0)::BIGINT, round_even(2 * m / 3.0, 0)::BIGINT, m)""",
)
part(
    "quality_rows",
    """SELECT *, CASE WHEN len(danger) > 0 THEN 'danger' WHEN len(warning) > 0 THEN 'warning' ELSE 'success' END AS quality_level FROM (SELECT *,
    list_filter([CASE WHEN ingest_status <> 'completed' THEN '当前入库状态为 ' || ingest_status END, CASE WHEN section_count = 0 THEN '未解析出任何章节。' END, CASE WHEN chunk_count = 0 THEN '未生成任何分块。' END], lambda x: x IS NOT NULL) AS danger,
    list_filter([CASE WHEN vector_chunk_count <> chunk_count THEN '向量索引条数 ' || vector_chunk_count || ' 与分块数 ' || chunk_count || ' 不一致。' END, CASE WHEN index_status <> 'indexed' THEN '当前索引状态为 ' || index_status || '，建议执行重建。' END,
      CASE WHEN section_count < 2 AND total_chunk_chars >= 2000 THEN '章节数偏少，长文档可能没有按标题切开。' END, CASE WHEN avg_chunks_per_section >= 12 THEN '平均每章分块数偏高，可能切得过碎。' END,
      CASE WHEN max_chunk_chars >= 700 THEN '存在超长分块，建议抽样检查分块边界。' END, CASE WHEN min_chunk_chars > 0 AND min_chunk_chars <= 30 AND chunk_count >= 3 THEN '存在过短分块，可能影响检索效果。' END], lambda x: x IS NOT NULL) AS warning FROM metrics)""",
)
MESSAGE = "CASE WHEN quality_level = 'success' THEN '入库结构与索引看起来正常。' ELSE '发现需要复核的问题，请结合抽样结果进一步检查。' END"
oracle("document_quality", f"SELECT doc_uid, array_to_string(danger || warning, '|') AS issues, quality_level, {MESSAGE} AS quality_message FROM quality_rows")
oracle(
    "document_quality_batch",
    "SELECT count(*) AS document_count, count(*) FILTER (quality_level = 'success') AS success_count, count(*) FILTER (quality_level = 'warning') AS warning_count, count(*) FILTER (quality_level = 'danger') AS danger_count FROM quality_rows",
)
oracle(
    "export_quality_csv",
    f"""SELECT doc_uid, doc_title, ingest_status, index_status, section_count::VARCHAR AS section_count, chunk_count::VARCHAR AS chunk_count, fts_chunk_count::VARCHAR AS fts_chunk_count, vector_chunk_count::VARCHAR AS vector_chunk_count,
    avg_chunk_chars::DOUBLE::VARCHAR AS avg_chunk_chars, avg_chunks_per_section::DOUBLE::VARCHAR AS avg_chunks_per_section, quality_level, {MESSAGE} AS quality_message, nullif(array_to_string(danger || warning, '；'), '') AS issues, source_path FROM quality_rows""",
)
THRESHOLDS = ", ".join(f"({n}, '{k}', {d}, {m})" for n, (k, (d, m)) in enumerate(lx.QUALITY_THRESHOLDS.items()))
oracle(
    "quality_thresholds",
    f"""SELECT setting_id, name, r AS resolved, CASE WHEN r IS NULL THEN 'not an integer' WHEN r < m THEN 'below minimum' END AS problem FROM (SELECT e.event_id AS setting_id, t.name, t.m,
    CASE e.event_id % 5 WHEN 0 THEN t.d WHEN 1 THEN NULL ELSE floor(e.value)::BIGINT END::BIGINT AS r FROM events e JOIN (VALUES {THRESHOLDS}) AS t(i, name, d, m) ON t.i = e.event_id % 7)""",
)
part(
    "summary_rows",
    """SELECT b.kb AS knowledge_base_id, coalesce(d.a, 0) AS document_count, coalesce(d.b, 0) AS completed_document_count, coalesce(d.c, 0) AS indexed_document_count, coalesce(d.d, 0) AS rebuild_pending_document_count, coalesce(d.e, 0) AS failed_document_count,
    coalesce(s.k, 0) AS section_count, coalesce(c.k, 0) AS chunk_count, coalesce(q.k, 0) AS quality_check_count, coalesce(m.k, 0) AS claim_count, coalesce(r.k, 0) AS review_count FROM (
      SELECT DISTINCT knowledge_base_id AS kb FROM docs UNION SELECT knowledge_base_id FROM review_checks) b
    LEFT JOIN (SELECT knowledge_base_id AS kb, count(*) AS a, count(*) FILTER (ingest_status = 'completed') AS b, count(*) FILTER (index_status = 'indexed') AS c, count(*) FILTER (index_status IN ('pending', 'rebuilding')) AS d,
      count(*) FILTER (index_status = 'partial_failed' OR ingest_status = 'failed') AS e FROM docs GROUP BY 1) d USING (kb)
    LEFT JOIN (SELECT knowledge_base_id AS kb, count(*) AS k FROM sections GROUP BY 1) s USING (kb) LEFT JOIN (SELECT knowledge_base_id AS kb, count(*) AS k FROM chunks GROUP BY 1) c USING (kb)
    LEFT JOIN (SELECT knowledge_base_id AS kb, count(*) AS k FROM review_checks GROUP BY 1) q USING (kb) LEFT JOIN (SELECT 'src' || (check_id % 20) AS kb, count(*) AS k FROM review_claims GROUP BY 1) m USING (kb)
    LEFT JOIN (SELECT 'src' || ((claim_id // 10) % 20) AS kb, count(*) AS k FROM review_rows GROUP BY 1) r USING (kb)""",
)
COUNTS = ("document_count", "completed_document_count", "indexed_document_count", "rebuild_pending_document_count", "failed_document_count", "section_count", "chunk_count", "quality_check_count", "claim_count", "review_count")
oracle("database_summary", "SELECT * FROM summary_rows UNION ALL SELECT NULL, " + ", ".join(f"sum({c})::BIGINT" for c in COUNTS) + " FROM summary_rows")
oracle(
    "list_documents",
    """SELECT doc_uid, doc_title, index_status, total FROM (SELECT *, row_number() OVER (ORDER BY updated_s DESC, doc_uid) AS r, count(*) OVER () AS total FROM docs WHERE knowledge_base_id = 'src3' AND ingest_status = 'completed') WHERE r BETWEEN 11 AND 20""",
)
part(
    "claim_status",
    """SELECT c.*, coalesce(r.a, 'pending') AS review_status, r.t AS updated_at FROM review_claims c LEFT JOIN (SELECT claim_id, max_by(review_action, {'t': created_at, 'i': review_id}) AS a, max(created_at) AS t FROM review_rows GROUP BY claim_id) r USING (claim_id)""",
)
part("recent_rows", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY knowledge_base_id ORDER BY created_at DESC, check_id DESC) AS position FROM review_checks) WHERE position <= 3")
oracle(
    "recent_checks",
    """SELECT r.check_id, r.knowledge_base_id, r.position, count(*) FILTER (c.review_status = 'pending') AS pending_claim_count, string_agg(c.claim_id::VARCHAR, ',' ORDER BY c.claim_no) AS claim_ids FROM recent_rows r JOIN claim_status c USING (check_id) GROUP BY 1, 2, 3""",
)
oracle("recent_claims", "SELECT r.check_id, r.knowledge_base_id, c.claim_no, c.claim_id, c.claim_text, c.verdict, c.risk_level, c.review_status FROM recent_rows r JOIN claim_status c USING (check_id)")
oracle(
    "claim_detail",
    """SELECT claim_id::VARCHAR AS claim_id, CASE WHEN src THEN CASE WHEN claim_id % 6 = 1 THEN 'span' ELSE claim_id::VARCHAR END END AS chunk_id, CASE WHEN src THEN CASE WHEN claim_id % 3 <> 0 THEN 'doc' || claim_id ELSE '' END END AS doc_uid,
    CASE WHEN src THEN CASE WHEN claim_id % 6 = 1 THEN 'span' ELSE '' END END AS source_span, CASE WHEN src THEN 'history_record' END AS context_mode, CASE WHEN src THEN CASE WHEN claim_id % 2 = 0 THEN 'support' ELSE 'insufficient' END END AS evidence_relation,
    CASE WHEN src THEN 'why' END AS relation_reason, CASE WHEN src THEN CASE WHEN claim_id % 5 = 0 THEN 'text' ELSE claim_text END END AS content_preview
    FROM (SELECT *, claim_id % 3 <> 0 OR claim_id % 6 = 1 OR claim_id % 5 = 0 AS src FROM review_claims)""",
)
oracle(
    "get_check_result",
    """SELECT t.check_id, v.v AS verdicts, r.r AS rules FROM texts_in t LEFT JOIN (SELECT check_id, string_agg(verdict, ',' ORDER BY claim_no) AS v FROM decided GROUP BY check_id) v USING (check_id)
    LEFT JOIN (SELECT check_id, string_agg(rule_code, ',' ORDER BY claim_id, rule_no) AS r FROM rule_hits GROUP BY check_id) r USING (check_id)""",
)
part(
    "catalog",
    """SELECT c.knowledge_base_id, c.doc_uid, d.doc_title, d.source_name, c.chunk_id, c.chunk_index, c.heading_path, c.source_start_line::BIGINT AS source_start_line, c.source_end_line::BIGINT AS source_end_line, c.source_anchor, c.chunk_type, substr(c.content, 1, 160) AS content_excerpt, c.content
    FROM chunks c JOIN docs d USING (doc_uid)""",
)
oracle("evidence_catalog", "SELECT * EXCLUDE (content) FROM catalog")
oracle("evidence_catalog_page", "SELECT doc_uid, chunk_id, chunk_index FROM catalog WHERE knowledge_base_id = 'src2' AND contains(lower(content), 'thon') ORDER BY doc_title, chunk_index, chunk_id LIMIT 200")
oracle(
    "paginate",
    """SELECT doc_uid, r AS row_no, least(3, pages) AS page, pages FROM (SELECT doc_uid, row_number() OVER (ORDER BY updated_s DESC, doc_uid) AS r, (count(*) OVER () + 24) // 25 AS pages FROM docs) WHERE r > (least(3, pages) - 1) * 25 AND r <= least(3, pages) * 25""",
)

# ------------------------------------------------------------------ H, I
oracle(
    "submit_reviews",
    """SELECT event_id AS review_id, user_id AS claim_id, CASE event_type WHEN 'click' THEN 'updated' ELSE 'rejected' END AS review_action FROM events WHERE event_type IN ('click', 'error') AND user_id % 4 <> 0""",
)
oracle("latest_review_status", "SELECT claim_id, review_status FROM claim_status")
part("queue", "SELECT c.*, k.knowledge_base_id, k.created_at AS check_created_at FROM claim_status c JOIN review_checks k USING (check_id)")
oracle(
    "review_queue",
    """SELECT claim_id, check_id, review_status, knowledge_base_id FROM queue ORDER BY CASE WHEN review_status = 'pending' THEN 0 ELSE 1 END, coalesce(updated_at, created_at, check_created_at) DESC, check_created_at DESC, created_at DESC, claim_id LIMIT 50""",
)
oracle("filter_review_queue", "SELECT claim_id, review_status, risk_level, 'processed' AS side FROM queue WHERE review_status <> 'pending' AND risk_level = 'high'")
oracle(
    "review_history",
    """SELECT review_id, claim_id, check_id, knowledge_base_id, review_action, position, total FROM (SELECT r.review_id, r.claim_id, r.claim_id // 10 AS check_id, 'src' || ((r.claim_id // 10) % 20) AS knowledge_base_id, r.review_action,
    row_number() OVER (PARTITION BY (r.claim_id // 10) % 20 ORDER BY r.created_at DESC, r.review_id DESC) AS position, count(*) OVER (PARTITION BY (r.claim_id // 10) % 20) AS total FROM review_rows r) WHERE position BETWEEN 16 AND 30""",
)
part("grants", "SELECT DISTINCT user_id, unnest(['src' || (user_id % 20), 'src' || ((user_id * 7) % 20)]) AS knowledge_base_id FROM (SELECT DISTINCT user_id FROM events)")
oracle(
    "scope_by_permission",
    """SELECT e.event_id, e.user_id, 'src' || (e.event_id % 20) AS knowledge_base_id FROM events e WHERE e.user_id % 50 = 0 OR EXISTS (SELECT 1 FROM grants g WHERE g.user_id = e.user_id AND g.knowledge_base_id = 'src' || (e.event_id % 20))""",
)
part("scoped_rows", "SELECT q.query_id, q.query_id || '|' || g.knowledge_base_id AS scope_id, g.knowledge_base_id, q.text FROM queries_in q JOIN grants g ON g.user_id = q.item_id")
part("scoped_variants", "SELECT e.key AS scope_id, e.variant_no, e.text, s.query_id AS qid, s.knowledge_base_id AS kb FROM (" + expansion_rows("SELECT scope_id AS key, text AS t FROM scoped_rows", 6) + ") e JOIN scoped_rows s ON s.scope_id = e.key")
part("all_matches", "SELECT m.*, v.kb, v.qid FROM (" + and_match("SELECT scope_id AS query_id, variant_no, text FROM scoped_variants") + ") m JOIN scoped_variants v ON v.scope_id = m.query_id AND v.variant_no = m.variant_no WHERE m.knowledge_base_id = v.kb")
oracle(
    "search_in_scope",
    """WITH found AS (SELECT qid, kb, query_id AS scope_id, variant_no, chunk_id, doc_uid, chunk_index, NULL::BIGINT AS newest FROM all_matches UNION ALL
      SELECT v.qid, v.kb, v.scope_id, v.variant_no, c.chunk_id, c.doc_uid, c.chunk_index, d.updated_s FROM scoped_variants v JOIN chunks c ON c.knowledge_base_id = v.kb AND contains(lower(c.content), lower(v.text)) JOIN docs d USING (doc_uid)
      WHERE NOT EXISTS (SELECT 1 FROM all_matches m WHERE m.query_id = v.scope_id AND m.variant_no = v.variant_no)),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope_id, variant_no ORDER BY newest DESC NULLS LAST, doc_uid, chunk_index) AS pos FROM found) WHERE pos <= 5),
    per_scope AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY variant_no, pos) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scope_id, chunk_id ORDER BY variant_no, pos) AS once FROM top) WHERE once = 1) WHERE rank <= 5)
    SELECT qid AS query_id, r AS rank, chunk_id, doc_uid, kb AS knowledge_base_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY kb, rank) AS r FROM per_scope) WHERE r <= 5""",
)
oracle(
    "resolve_object_kb",
    """SELECT e.event_id, CASE e.event_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'check' ELSE 'claim' END AS kind, CASE e.event_id % 3 WHEN 0 THEN 'd' || lpad(e.user_id::VARCHAR, 9, '0') ELSE e.user_id::VARCHAR END AS object_id,
    CASE e.event_id % 3 WHEN 0 THEN d.source WHEN 1 THEN k.knowledge_base_id ELSE 'src' || (c.check_id % 20) END AS knowledge_base_id FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id LEFT JOIN review_checks k ON k.check_id = e.user_id LEFT JOIN review_claims c ON c.claim_id = e.user_id""",
)

# ------------------------------------------------------------------ J
part(
    "retrieval_cases",
    """SELECT q.query_id, coalesce(bool_or(g.doc_id IS NOT NULL), FALSE) AS top_k_hit, count(DISTINCT f.chunk_id) > 0 AS traceable, count(DISTINCT f.chunk_id) AS returned FROM queries_in q LEFT JOIN fulltext f ON f.query_id = q.query_id
    LEFT JOIN documents g ON 'd' || lpad(g.doc_id::VARCHAR, 9, '0') = f.doc_uid AND contains(g.text, q.text) WHERE q.query_id LIKE 'b%' GROUP BY q.query_id""",
)
oracle("eval_retrieval_cases", "SELECT * FROM retrieval_cases")
part(
    "retrieval_summary",
    """SELECT count(*) AS case_count, count(*) FILTER (top_k_hit) AS top_k_hit_count, round(count(*) FILTER (top_k_hit) / count(*), 4) AS top_k_hit_rate, count(*) FILTER (traceable) AS traceable_case_count,
    round(count(*) FILTER (traceable) / count(*), 4) AS traceability_rate FROM retrieval_cases""",
)
oracle("eval_retrieval_summary", "SELECT * FROM retrieval_summary")
PICK = lambda c: f"CASE ({c}) % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'needs_review' ELSE 'rejected' END"
part(
    "claim_eval",
    f"""SELECT case_id, expected_verdict, coalesce(v, '') AS actual_verdict, expected_verdict = coalesce(v, '') AS verdict_matched, coalesce(k > 0, FALSE) AS has_evidence, coalesce(v, '') = 'verified' AND NOT coalesce(k > 0, FALSE) AS no_evidence_verified FROM (
    SELECT l.doc_id AS case_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'verified' ELSE 'needs_review' END AS expected_verdict,
      CASE WHEN d.doc_id % 3 = 1 THEN {PICK('length(d.lang) + d.doc_id')} ELSE {PICK('d.n_chars')} END AS v, CASE WHEN d.doc_id % 3 = 1 THEN d.doc_id % 2 ELSE d.doc_id % 4 END AS k
    FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 11 <> 0) d USING (doc_id))""",
)
part("claim_eval_rows", "SELECT case_id, expected_verdict, CASE WHEN known THEN actual_verdict ELSE '' END AS actual_verdict, verdict_matched AND known AS verdict_matched, has_evidence, no_evidence_verified AND known AS no_evidence_verified FROM (SELECT *, case_id % 11 <> 0 AS known FROM claim_eval)")
oracle("eval_claim_results", "SELECT * FROM claim_eval_rows")
part(
    "claim_eval_summary",
    """SELECT count(*) AS case_count, count(*) FILTER (verdict_matched) AS verdict_match_count, round(count(*) FILTER (verdict_matched) / count(*), 4) AS verdict_accuracy, count(*) FILTER (no_evidence_verified) AS no_evidence_verified_count,
    round(count(*) FILTER (no_evidence_verified) / count(*), 4) AS no_evidence_verified_rate FROM claim_eval_rows""",
)
oracle("eval_claim_summary", "SELECT * FROM claim_eval_summary")
part(
    "suite",
    f"""SELECT *, a AND b AND c AS all_matched FROM (SELECT o.check_id AS case_id, o.overall_verdict, o.risk_level, o.claim_count, CASE t.conv_id % 3 WHEN 0 THEN overall_verdict = 'passed' WHEN 1 THEN overall_verdict = 'rejected' ELSE TRUE END AS a,
    t.conv_id % 2 <> 0 OR risk_level = 'high' AS b, t.conv_id % 4 = 0 OR claim_count = 1 AS c FROM (
      SELECT check_id, CASE WHEN bool_or(verdict = 'rejected') THEN 'rejected' WHEN bool_and(verdict = 'verified') THEN 'passed' ELSE 'needs_review' END AS overall_verdict, {named(f"max({rank('risk_level', lx.RISK_RANK, 0)})", lx.RISK_RANK)} AS risk_level, count(*) AS claim_count
      FROM decided GROUP BY check_id) o JOIN texts_in t USING (check_id))""",
)
oracle("eval_check_suite", "SELECT case_id, overall_verdict, risk_level, claim_count, a AS overall_verdict_matched, b AS risk_level_matched, c AS claim_count_matched, all_matched FROM suite")
oracle("eval_check_totals", "SELECT count(*) AS case_count, count(*) FILTER (a) AS overall_verdict_match_count, count(*) FILTER (b) AS risk_level_match_count, count(*) FILTER (c) AS claim_count_match_count, count(*) FILTER (all_matched) AS exact_match_count FROM suite")
DIFFS = "list_filter([CASE WHEN NOT a THEN '结论不一致' END, CASE WHEN NOT b THEN '风险等级不一致' END, CASE WHEN NOT c THEN 'Claim 拆分不一致' END], lambda x: x IS NOT NULL)"
oracle("describe_mismatch", f"SELECT case_id, len(d) <= 1 AS loose_match, CASE WHEN len(d) = 0 THEN '三项均命中' ELSE array_to_string(d, '；') END AS diff FROM (SELECT case_id, {DIFFS} AS d FROM suite)")
oracle(
    "eval_failure_breakdown",
    """WITH t AS (SELECT count(*) AS n, count(*) FILTER (a::INT + b::INT + c::INT >= 2) AS l, count(*) FILTER (all_matched) AS e, count(*) FILTER (NOT a) AS x, count(*) FILTER (NOT b) AS y, count(*) FILTER (NOT c) AS z FROM suite)
    SELECT n AS case_count, l AS loose_match_count, e AS exact_match_count, printf('%.1f%%', l / n * 100) AS loose_match_rate, printf('%.1f%%', e / n * 100) AS exact_match_rate,
    CASE WHEN greatest(x, y, z) = 0 THEN '无明显失败项' ELSE array_to_string(list_filter([CASE WHEN x = greatest(x, y, z) THEN '结论不一致' END, CASE WHEN y = greatest(x, y, z) THEN '风险等级不一致' END, CASE WHEN z = greatest(x, y, z) THEN 'Claim 拆分不一致' END], lambda v: v IS NOT NULL), ' / ')
      || '（' || greatest(x, y, z) || ' 条）' END AS primary_failure_reason FROM t""",
)
part("align_cases", "SELECT k.item_id AS case_id, k.text AS query, b.text AS expected_evidence FROM queries_in k JOIN benchmark b USING (item_id) WHERE k.query_id LIKE 'k%'")
part(
    "alignments",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, doc_title, chunk_index, chunk_id) AS rank FROM (
      SELECT w.case_id, i.chunk_id, i.doc_uid, i.doc_title, i.chunk_index, sum(w.w)::BIGINT AS score FROM (
        SELECT case_id, unnest({overlap_terms('query')}) AS term, 2 AS w FROM align_cases UNION ALL SELECT case_id, unnest({overlap_terms('expected_evidence')}), 1 FROM align_cases) w
      JOIN (SELECT chunk_id, doc_uid, doc_title, chunk_index, unnest({overlap_terms("doc_title || ' ' || heading_path || ' ' || content")}) AS term FROM catalog) i USING (term) GROUP BY ALL)) WHERE rank <= 3""",
)
oracle("suggest_alignments", "SELECT case_id, rank, chunk_id, doc_uid, score FROM alignments")
oracle("alignment_coverage", "SELECT count(*) AS case_count, count(a.case_id) AS suggested_case_count, round(count(a.case_id) / count(*), 4) AS suggestion_rate FROM align_cases c LEFT JOIN (SELECT DISTINCT case_id FROM alignments) a USING (case_id)")
oracle(
    "eval_report_rows",
    """SELECT 'retrieval' AS section, unnest(['检索样例数', 'Top-K 命中数', 'Top-K 命中率', '证据追溯率']) AS metric, unnest([case_count::DOUBLE, top_k_hit_count::DOUBLE, top_k_hit_rate, traceability_rate]) AS value FROM retrieval_summary
    UNION ALL SELECT 'claim', unnest(['Claim 样例数', 'Claim 准确率', '无证据 verified 率']), unnest([case_count::DOUBLE, verdict_accuracy, no_evidence_verified_rate]) FROM claim_eval_summary""",
)
BAR = lambda c: f"replace(coalesce({c}, '-'), '|', '\\|') AS {c.split('.')[-1]}"
oracle(
    "align_report_rows",
    f"""SELECT c.case_id, coalesce(a.rank, 0) AS rank, coalesce(a.score, 0) AS score, {BAR('a.doc_uid')}, {BAR('a.chunk_id')}, {BAR('k.doc_title')}, {BAR('k.heading_path')}, {BAR('k.source_anchor')}, {BAR('k.content_excerpt')}
    FROM align_cases c LEFT JOIN alignments a USING (case_id) LEFT JOIN catalog k ON k.chunk_id = a.chunk_id""",
)

# ------------------------------------------------------------------ K, L
oracle("stream_progress", "SELECT user_id AS doc_uid, max_by(event_type, event_id) AS stage, max_by(value, event_id) AS percent FROM events GROUP BY user_id")
oracle(
    "overall_progress",
    "SELECT count(*) AS document_count, round(avg(p), 2) AS overall_percent FROM (SELECT max_by(value, event_id) AS p FROM events GROUP BY user_id)",
)
oracle("stream_review_status", "SELECT claim_id, review_status FROM claim_status WHERE claim_id IN (SELECT claim_id FROM review_rows)")
oracle("embed_with", "SELECT chunk_id, length(content)::DOUBLE AS chars, (length(content) - length(replace(content, 'e', '')))::DOUBLE AS es FROM chunks")
oracle(
    "rerank_with",
    """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank) AS rank, chunk_id, s AS rerank_score FROM (SELECT f.query_id, f.rank, f.chunk_id,
    CASE WHEN NOT contains(q.text, 'x') AND count(*) OVER (PARTITION BY f.query_id) > 1 THEN length(c.content)::DOUBLE END AS s FROM fulltext f JOIN queries_in q USING (query_id) JOIN chunks c ON c.chunk_id = f.chunk_id)""",
)
