"""Comparison SQL: retrieval and vectors."""

from __future__ import annotations

from verification import inputs as vi
from verification.sql.base import any_of, lit, no_space, oracle, part, strip, words
from verification.sql.s_structure import COMPACT
from verification.sql.s_text import ESC, QX, expansion_rows, search_text, squeeze, tokens

part("chunk_words", f"SELECT chunk_id, doc_uid, knowledge_base_id, chunk_index, {words('index_text')} AS ws FROM index_texts")
part("postings", "SELECT unnest(ws) AS term, chunk_id, doc_uid, knowledge_base_id, chunk_index FROM chunk_words")
oracle("build_postings", "SELECT term, chunk_id, doc_uid, knowledge_base_id FROM postings")


def and_match(source: str) -> str:
    """Matches of a (query_id, variant_no, text, doc_uid?) source: every term of the text occurs."""
    return f"""SELECT v.query_id, v.variant_no, p.chunk_id, p.doc_uid, p.knowledge_base_id, p.chunk_index FROM (
      SELECT *, unnest(ws) AS term, len(ws) AS n FROM (SELECT *, {words('text')} AS ws FROM ({source}))) v JOIN postings p ON p.term = v.term
    GROUP BY v.query_id, v.variant_no, v.n, p.chunk_id, p.doc_uid, p.knowledge_base_id, p.chunk_index HAVING count(*) = v.n"""


part("matches", and_match("SELECT * FROM variants"))
oracle("fulltext_match", "SELECT query_id, variant_no, chunk_id, doc_uid, chunk_index FROM matches")
part(
    "fallbacks",
    """SELECT v.query_id, v.variant_no, c.chunk_id, c.doc_uid, c.chunk_index FROM variants v JOIN chunks c ON contains(lower(c.content), lower(v.text))
    WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.query_id = v.query_id AND m.variant_no = v.variant_no)""",
)
oracle(
    "substring_fallback",
    f"""WITH pieces AS (SELECT 'p' || query_id AS query_id, 1 AS variant_no, regexp_extract(text, '^[^ ]([^ ]+)', 1) AS text FROM queries_in WHERE query_id LIKE 'k%'),
    piece_hits AS ({and_match("SELECT * FROM pieces")})
    SELECT query_id, variant_no::BIGINT AS variant_no, chunk_id, doc_uid, chunk_index FROM fallbacks UNION ALL
    SELECT p.query_id, p.variant_no, c.chunk_id, c.doc_uid, c.chunk_index FROM pieces p JOIN chunks c ON contains(lower(c.content), lower(p.text))
    WHERE p.text <> '' AND NOT EXISTS (SELECT 1 FROM piece_hits m WHERE m.query_id = p.query_id)""",
)
part(
    "fulltext",
    """SELECT query_id, rank, chunk_id, doc_uid FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant_no, pos) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY variant_no, pos) AS once FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY newest DESC NULLS LAST, doc_uid, chunk_index) AS pos FROM (
          SELECT query_id, variant_no, chunk_id, doc_uid, chunk_index, NULL::BIGINT AS newest FROM matches UNION ALL
          SELECT f.query_id, f.variant_no, f.chunk_id, f.doc_uid, f.chunk_index, d.updated_s FROM fallbacks f JOIN docs d USING (doc_uid)))
      WHERE pos <= 10) WHERE once = 1) WHERE rank <= 10""",
)
oracle("fulltext_search", "SELECT query_id, rank, chunk_id, doc_uid FROM fulltext")


def embedding(source: str) -> str:
    """(key, slot, value) of a (key, t) source; zero slots left out."""
    return f"""SELECT key, slot, sum(w) / max(n) AS value FROM (
      SELECT key, n, ('0x' || md5(c)[1:2])::INT % 64 AS slot, k * (('0x' || md5(c)[3:4])::INT % 17 + 1) / 17.0::DOUBLE AS w FROM (
        SELECT key, n, c, count(*) AS k FROM (SELECT key, length({strip('t')}) AS n, unnest(string_split({strip('t')}, '')) AS c FROM ({source})) GROUP BY key, n, c))
    GROUP BY key, slot"""


part("chunk_slots", embedding("SELECT chunk_id AS key, content AS t FROM chunks"))
oracle("embed_hash", "SELECT s.key AS chunk_id, s.slot::BIGINT AS slot, round(s.value * 17 * c.token_count)::BIGINT AS weight FROM chunk_slots s JOIN chunks c ON c.chunk_id = s.key WHERE s.value <> 0")


def dense(source: str) -> str:
    return f"""SELECT key, list(coalesce(value, 0.0) ORDER BY s) AS e FROM (
      SELECT k.key, r.s, t.value FROM (SELECT DISTINCT key FROM {source}) k CROSS JOIN (SELECT unnest(range(0, 64)) AS s) r
      LEFT JOIN {source} t ON t.key = k.key AND t.slot = r.s) GROUP BY key"""


part("query_slots", embedding("SELECT query_id AS key, text AS t FROM queries_in"))
part("chunk_vectors", dense("chunk_slots"))
part("query_vectors", dense("query_slots"))
DIST = "round(list_sum(list_transform(range(1, 65), lambda j: (a.e[j] - b.e[j]) * (a.e[j] - b.e[j]))), 6)"
oracle(
    "vector_search",
    f"""SELECT query_id, rank, chunk_id, doc_uid, round(1 - d, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM (
      SELECT q.query_id, c.chunk_id, c.doc_uid, {DIST} AS d FROM queries_in q JOIN query_vectors a ON a.key = q.query_id
      JOIN chunks c ON c.knowledge_base_id = 'src' || (q.item_id % 20) JOIN chunk_vectors b ON b.key = c.chunk_id)) WHERE rank <= 10""",
)
STORED = f"""SELECT query_id, rank, chunk_id, round(1 - d, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {DIST.replace('.e[j]', '.embedding[j]::DOUBLE')} AS d FROM embeddings a, embeddings b)) WHERE rank <= 5"""
oracle("vector_search_stored", STORED)
oracle("vector_search_cells", STORED)
part(
    "vector_hits",
    f"""SELECT query_id, rank, chunk_id, doc_uid, 1 - d AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM (
      SELECT a.key AS query_id, c.chunk_id, c.doc_uid, {DIST} AS d FROM query_vectors a, chunks c JOIN chunk_vectors b ON b.key = c.chunk_id)) WHERE rank <= 10""",
)
part(
    "hybrid",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fr NULLS LAST, vr NULLS LAST, chunk_id) AS rank FROM (
      SELECT coalesce(f.query_id, v.query_id) AS query_id, coalesce(f.chunk_id, v.chunk_id) AS chunk_id, coalesce(f.doc_uid, v.doc_uid) AS doc_uid, f.rank AS fr, v.rank AS vr,
        CASE WHEN f.rank IS NOT NULL AND v.rank IS NOT NULL THEN greatest(0.0, v.score) ELSE v.score END AS score
      FROM fulltext f FULL JOIN vector_hits v ON v.query_id = f.query_id AND v.chunk_id = f.chunk_id)) WHERE rank <= 10""",
)
oracle(
    "hybrid_search",
    """SELECT query_id, rank, chunk_id, doc_uid, round(score, 6) AS score,
    CASE WHEN fr IS NOT NULL AND vr IS NOT NULL THEN 'hybrid' WHEN fr IS NOT NULL THEN 'fulltext' ELSE 'vector' END AS retrieval_source,
    CASE WHEN fr IS NOT NULL AND vr IS NOT NULL THEN 'fulltext|vector' WHEN fr IS NOT NULL THEN 'fulltext' ELSE 'vector' END AS matched_sources FROM hybrid""",
)
oracle(
    "attach_metadata",
    """SELECT f.query_id, f.rank, f.chunk_id, f.doc_uid, d.knowledge_base_id, coalesce(d.doc_title, '') AS doc_title, coalesce(d.author, '') AS author, coalesce(d.source_name, '') AS source_name,
    CASE WHEN json_valid(tags_json) THEN d.lang || '|' || d.source ELSE '' END AS tags FROM fulltext f JOIN docs d USING (doc_uid) WHERE d.ingest_status = 'completed'""",
)
part(
    "query_terms",
    f"""SELECT query_id, t, row_number() OVER (PARTITION BY query_id ORDER BY length(t) DESC, k) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM (
      SELECT query_id, t, min(k) AS k FROM (SELECT query_id, unnest(l) AS t, generate_subscripts(l, 1) AS k FROM (
        SELECT query_id, {tokens(squeeze(search_text('text')))} AS l FROM queries_in)) GROUP BY query_id, t)""",
)
part(
    "marking",
    f"""RECURSIVE SELECT query_id, chunk_id, 0::BIGINT AS r, (SELECT max(n) FROM query_terms q WHERE q.query_id = f.query_id) AS n, {ESC('substr(content, 1, 200)')} AS h
      FROM (SELECT f.query_id, c.chunk_id, c.content FROM fulltext f JOIN chunks c USING (chunk_id)) f
    UNION ALL SELECT m.query_id, m.chunk_id, q.r, m.n, replace(m.h, {ESC('q.t')}, '<mark>' || {ESC('q.t')} || '</mark>') FROM marking m JOIN query_terms q ON q.query_id = m.query_id AND q.r = m.r + 1""",
)
oracle(
    "preview_results",
    """SELECT f.query_id, f.rank, f.chunk_id, f.doc_uid, c.source_span, 'fulltext' AS retrieval_source, substr(c.content, 1, 200) AS content_preview,
    m.h AS content_preview_highlighted, count(*) OVER (PARTITION BY f.query_id) AS result_count
    FROM fulltext f JOIN chunks c USING (chunk_id) JOIN marking m ON m.query_id = f.query_id AND m.chunk_id = f.chunk_id AND m.r = m.n""",
)
oracle(
    "apply_rerank",
    """WITH scores AS (SELECT query_id, rank - CASE WHEN rank = 1 THEN 2 ELSE 1 END AS item_index, (substr(query_id, 2)::INT * 31 + rank * 17) % 101 / 100.0::DOUBLE AS s FROM hybrid WHERE rank % 3 <> 0),
    scored AS (SELECT h.query_id, h.rank, h.chunk_id, s.s, count(s.s) OVER (PARTITION BY h.query_id) AS k, count(*) OVER (PARTITION BY h.query_id) AS n
      FROM hybrid h LEFT JOIN scores s ON s.query_id = h.query_id AND s.item_index = h.rank - 1)
    SELECT query_id, r AS rank, chunk_id, s AS rerank_score FROM (SELECT query_id, chunk_id, CASE WHEN k > 0 AND n > 1 THEN s END AS s,
      row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN k > 0 AND n > 1 THEN s END DESC NULLS LAST, rank) AS r FROM scored WHERE NOT (k > 0 AND n > 1) OR s IS NOT NULL) WHERE r <= 5""",
)
oracle(
    "expand_context",
    f"""WITH base AS (SELECT f.query_id, f.rank % 3 AS w, f.rank % 2 = 0 AS sc, c.* FROM fulltext f JOIN chunks c USING (chunk_id)),
    around AS (SELECT b.query_id, b.chunk_id, string_agg('[' || n.source_span || '] ' || n.content, chr(10) ORDER BY n.chunk_index) AS t FROM base b JOIN chunks n
      ON n.section_id = b.section_id AND n.chunk_index BETWEEN b.chunk_index - b.w AND b.chunk_index + b.w WHERE b.w > 0 GROUP BY b.query_id, b.chunk_id)
    SELECT b.query_id, b.chunk_id, b.section_title, CASE WHEN sc THEN 'section_context' WHEN w > 0 THEN 'neighbor_chunks' ELSE 'chunk' END AS context_mode,
      CASE WHEN sc THEN {strip("coalesce(a.t, b.content) || chr(10) || chr(10) || '[章节上下文] ' || substr(s.content, 1, 300)")} ELSE coalesce(a.t, b.content) END AS expanded_content
    FROM base b JOIN sections s ON s.section_id = b.section_id LEFT JOIN around a ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id""",
)
oracle(
    "chunk_detail",
    """SELECT c.chunk_id, c.doc_uid, d.knowledge_base_id, d.doc_title, coalesce(d.author, '') AS author, coalesce(d.source_name, '') AS source_name, s.section_title, c.chunk_index, c.content
    FROM chunks c JOIN docs d USING (doc_uid) LEFT JOIN sections s ON s.section_id = c.section_id""",
)


def section_score(scope: str) -> str:
    """Scores of sections for tree_rows' terms; ``scope`` joins question and section."""
    hay = no_space("lower(s.section_title || ' ' || s.content)")
    title = no_space("lower(s.section_title)")
    term = no_space("lower(t.term)")
    generic = any_of("section_title", QX.front_matter)
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_uid ORDER BY score DESC, section_level, source_start_line, section_no) AS rank FROM (
      SELECT *, greatest(raw - CASE WHEN {generic} THEN 8 ELSE 0 END - CASE WHEN {generic} AND source_start_line > 0 AND source_start_line <= 80 THEN 4 ELSE 0 END
        - CASE WHEN regexp_matches(section_title, '/[0-9]+') THEN 6 ELSE 0 END, 0) AS score FROM (
        SELECT t.question_id, s.doc_uid, s.section_no, s.section_title, s.section_level, s.source_start_line, s.source_anchor, s.content,
          sum(CASE WHEN contains({title}, {term}) THEN 4 ELSE 2 END) AS raw
        FROM tree_rows t JOIN benchmark q ON q.item_id = t.question_id JOIN sections s ON {scope} WHERE contains({hay}, {term}) GROUP BY ALL)) WHERE score > 0) WHERE rank <= 30"""


part("section_scores", section_score("s.knowledge_base_id = 'src' || (q.item_id % 20)"))
oracle("score_sections", "SELECT question_id, doc_uid, section_no::BIGINT AS section_no, score::BIGINT AS score, rank FROM section_scores")
part("done_docs", "SELECT doc_uid, knowledge_base_id FROM docs WHERE ingest_status = 'completed'")
part(
    "doc_terms",
    """SELECT q.item_id || '@' || d.doc_uid AS query_id, c.question_id, d.doc_uid, c.term_no AS variant_no, c.term AS text FROM chunk_rows c
    JOIN benchmark q ON q.item_id = c.question_id JOIN done_docs d ON d.knowledge_base_id = 'src' || (q.item_id % 20)""",
)
part(
    "doc_matches",
    f"""SELECT t.query_id, t.variant_no, c.chunk_id, c.chunk_index FROM (SELECT *, {words('text')} AS need FROM doc_terms) t JOIN chunk_words c ON c.doc_uid = t.doc_uid
    AND len(t.need) > 0 AND len(list_filter(t.need, lambda v: NOT list_contains(c.ws, v))) = 0""",
)
part(
    "doc_candidates",
    """SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY chunk_index) AS pos FROM (
      SELECT * FROM doc_matches UNION ALL
      SELECT t.query_id, t.variant_no, c.chunk_id, c.chunk_index FROM doc_terms t JOIN chunks c ON c.doc_uid = t.doc_uid AND contains(lower(c.content), lower(t.text))
      WHERE NOT EXISTS (SELECT 1 FROM doc_matches m WHERE m.query_id = t.query_id AND m.variant_no = t.variant_no))""",
)
AT = "(strpos(c.content, t.text) - 1)"
WINDOW = f"substr(c.content, greatest({AT} - 18, 0) + 1, {AT} + length(t.text) + 24 - greatest({AT} - 18, 0))"
part(
    "supplements",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_uid ORDER BY variant_no, pos, chunk_id) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id, doc_uid, chunk_id ORDER BY variant_no, pos) AS once FROM (
        SELECT t.question_id, t.doc_uid, t.variant_no, k.pos, c.chunk_id, t.text AS term, c.source_span, c.source_anchor, c.content FROM doc_candidates k JOIN doc_terms t
          ON t.query_id = k.query_id AND t.variant_no = k.variant_no JOIN chunks c ON c.chunk_id = k.chunk_id
        JOIN question_lists ql ON ql.key = t.question_id
        WHERE k.pos <= 3 AND contains(c.content, t.text) AND (NOT list_contains(ql.terms, {lit(QX.subject)}) OR contains(c.content, {lit(QX.subject)}))
          AND NOT {any_of(WINDOW, QX.incidental)})) WHERE once = 1) WHERE rank <= 2""",
)
oracle("supplement_chunks", "SELECT question_id, doc_uid, rank, chunk_id, term FROM supplements")
part(
    "local_evidence",
    """SELECT question_id, doc_uid, 'PageIndex 节点' AS source_type, source_anchor AS evidence_key, section_title AS title, source_anchor AS position, '' AS source_anchor, '' AS chunk_id, content, 1 AS part, rank
      FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_uid, source_anchor ORDER BY rank) AS once FROM section_scores WHERE rank <= 3 AND doc_uid IN (SELECT doc_uid FROM done_docs)) WHERE once = 1
    UNION ALL SELECT question_id, doc_uid, 'RAG/FTS 原文', chunk_id, 'RAG/FTS 原文片段', source_span, source_anchor, chunk_id, content, 2, rank FROM supplements""",
)
oracle("rank_sections_local", "SELECT question_id, doc_uid, source_type, evidence_key, part::BIGINT AS part, rank FROM local_evidence")
part("kb_evidence", "SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY doc_uid, part, rank) AS position_no FROM local_evidence")
oracle("collect_kb_evidence", "SELECT question_id, position_no, doc_uid, title, position, chunk_id FROM kb_evidence")
oracle(
    "merge_evidence",
    """SELECT question_id, doc_uid, source_anchor AS evidence_key, CASE WHEN rank <= 2 THEN 1 ELSE 2 END::BIGINT AS part, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, doc_uid, source_anchor ORDER BY rank) AS once FROM section_scores WHERE rank <= 3) WHERE once = 1""",
)
oracle(
    "available_documents",
    """SELECT knowledge_base_id, doc_uid, doc_title, row_number() OVER (PARTITION BY knowledge_base_id ORDER BY updated_s DESC, doc_title, doc_uid) AS position FROM docs WHERE ingest_status = 'completed'""",
)
oracle(
    "query_history",
    """SELECT knowledge_base_id, position, event_id AS query_id, event_type AS question, props AS answer, CASE WHEN event_id % 3 = 0 THEN 'summary' ELSE 'unknown' END AS question_type,
    CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 END::BIGINT AS evidence_count, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'u' || user_id END AS first_doc FROM (
    SELECT *, 'src' || (user_id % 20) AS knowledge_base_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) AS position FROM events) WHERE position <= 20""",
)
oracle("rebuild_vectors", "SELECT count(DISTINCT doc_uid) AS document_count, count(*) AS chunk_count FROM chunks")
oracle(
    "check_vector_dimension",
    """SELECT s.key AS chunk_id, ('0x' || s.key[1:4])::INT % 3 = 0 AS recomputed, 64::BIGINT AS dimension, round(sum(s.value) * 17 * any_value(c.token_count))::BIGINT AS weight
    FROM chunk_slots s JOIN chunks c ON c.chunk_id = s.key GROUP BY s.key""",
)
oracle(
    "index_consistency",
    """SELECT doc_uid, chunk_count, CASE WHEN substr(doc_uid, 2)::INT % 9 = 0 THEN 0 ELSE chunk_count END AS indexed_count, CASE WHEN substr(doc_uid, 2)::INT % 10 = 0 THEN 0 ELSE chunk_count END AS vector_count,
    substr(doc_uid, 2)::INT % 9 <> 0 AND substr(doc_uid, 2)::INT % 10 <> 0 AS consistent FROM (SELECT doc_uid, count(*) AS chunk_count FROM chunks GROUP BY doc_uid)""",
)
