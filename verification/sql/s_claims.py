"""Comparison SQL: claims, rules, verdicts, relations, answers."""

from __future__ import annotations

from attestry import lexicons as lx
from attestry.operators import claims as cl
from attestry.operators import relation as rl
from attestry.operators import retrieval as rt
from verification import inputs as vi
from verification.sql.base import any_of, lit, no_space, oracle, part, strip, words
from verification.sql.s_retrieval import dense, embedding
from verification.sql.s_text import expansion_rows, in_order, replaces, strings

LX, RX = vi.LOGIC, vi.RELATION

oracle("split_claims", "SELECT check_id, claim_no, claim_id, claim_text FROM claims")
oracle("claim_logic", "SELECT claim_id, has_exclusive, has_universal, has_negation, has_comparison, is_strict FROM flagged_claims")


def rule_rows() -> str:
    rows = []
    for n, r in enumerate(vi.RULES, start=1):
        message = lit(r["message"]) if "message" in r else "NULL"
        rows.append(f"({n}, {lit(r['code'])}, {lit(r.get('name', ''))}, {strings(r['keywords'])}, {lit(r.get('hit_level', 'warn'))}, {message}, {strings(r['template_tags'])})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(rule_no, code, name, keywords, hit_level, message, tags)"


part("rule_set", rule_rows())
TAG = "(CASE WHEN conv_id % 2 = 0 THEN 'general' ELSE 'strict' END)"
part(
    "rule_hits",
    f"""SELECT check_id, claim_id, rule_no, code AS rule_code, name AS rule_name, hit_level, coalesce(message, '命中规则关键词：' || k) AS hit_message, k AS matched_keyword FROM (
    SELECT *, list_filter(keywords, lambda w: contains(claim_text, w))[1] AS k FROM claims, rule_set WHERE len(tags) = 0 OR list_contains(tags, {TAG})) WHERE k IS NOT NULL""",
)
oracle("match_rules", "SELECT * REPLACE (rule_no::BIGINT AS rule_no) FROM rule_hits")
oracle("match_rule_table", "SELECT * REPLACE (rule_no::BIGINT AS rule_no) FROM rule_hits")
oracle(
    "filter_rules_by_tags",
    f"SELECT 'c' || conv_id || '-' || turn AS template_id, code FROM conversations, rule_set WHERE len(tags) = 0 OR list_contains(tags, {TAG})",
)


def rank(x: str, ranks: dict, default: int) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN {v}" for k, v in ranks.items()) + f" ELSE {default} END"


def named(x: str, ranks: dict) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {v} THEN '{k}'" for k, v in ranks.items()) + " END"


part("levels", f"SELECT claim_id, {named('r', lx.LEVEL_RANK)} AS max_level FROM (SELECT claim_id, max({rank('hit_level', lx.LEVEL_RANK, 1)}) AS r FROM rule_hits GROUP BY claim_id)")
oracle("max_rule_level", "SELECT * FROM levels")
LIMITS = rt.gathering_limits()
# The check's own search for every labelled query of a claim, inside the knowledge base of its text.
part("claim_texts", "SELECT q.claim_id || ':' || q.query_no AS query_id, q.claim_id, q.query_no, q.label, q.text, 'src' || (c.conv_id % 20) AS kb FROM claim_queries q JOIN claims c USING (claim_id)")
part("claim_variants", "SELECT key AS query_id, variant_no, v.text, kb FROM (" + expansion_rows("SELECT query_id AS key, text AS t FROM claim_texts", 6) + ") v JOIN claim_texts q ON q.query_id = v.key")
part(
    "claim_matches",
    f"""SELECT v.query_id, v.variant_no, p.chunk_id, p.doc_uid, p.chunk_index FROM (SELECT *, unnest(ws) AS term, len(ws) AS n FROM (SELECT *, {words('text')} AS ws FROM claim_variants)) v
    JOIN postings p ON p.term = v.term AND p.knowledge_base_id = v.kb GROUP BY v.query_id, v.variant_no, v.n, p.chunk_id, p.doc_uid, p.chunk_index HAVING count(*) = v.n""",
)
part(
    "claim_fallbacks",
    """SELECT v.query_id, v.variant_no, c.chunk_id, c.doc_uid, c.chunk_index FROM claim_variants v JOIN chunks c ON c.knowledge_base_id = v.kb AND contains(lower(c.content), lower(v.text))
    WHERE NOT EXISTS (SELECT 1 FROM claim_matches m WHERE m.query_id = v.query_id AND m.variant_no = v.variant_no)""",
)
part(
    "claim_fulltext",
    f"""SELECT query_id, rank, chunk_id, doc_uid FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant_no, pos) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY variant_no, pos) AS once FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY newest DESC NULLS LAST, doc_uid, chunk_index) AS pos FROM (
          SELECT query_id, variant_no, chunk_id, doc_uid, chunk_index, NULL::BIGINT AS newest FROM claim_matches UNION ALL
          SELECT f.query_id, f.variant_no, f.chunk_id, f.doc_uid, f.chunk_index, d.updated_s FROM claim_fallbacks f JOIN docs d USING (doc_uid)))
      WHERE pos <= {LIMITS['fulltext']}) WHERE once = 1) WHERE rank <= {LIMITS['fulltext']}""",
)
part("claim_slots", embedding("SELECT DISTINCT text AS key, text AS t FROM claim_texts"))
part("claim_vectors", dense("claim_slots"))
part(
    "claim_nearest",
    f"""SELECT query_id, rank, chunk_id, doc_uid FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM (
      SELECT q.query_id, c.chunk_id, c.doc_uid, round(pow(list_distance(a.e, b.e), 2), 6) AS d FROM claim_texts q JOIN claim_vectors a ON a.key = q.text
      JOIN chunks c ON c.knowledge_base_id = q.kb JOIN chunk_vectors b ON b.key = c.chunk_id)) WHERE rank <= {LIMITS['vector']}""",
)
part(
    "labelled",
    f"""SELECT q.claim_id, q.query_no, q.label, h.chunk_id, h.doc_uid, h.rank, NULL::DOUBLE AS rerank_score, h.src, CASE h.src WHEN 'hybrid' THEN ['fulltext', 'vector', 'hybrid'] ELSE [h.src] END AS ms FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fr NULLS LAST, vr NULLS LAST, chunk_id) AS rank FROM (
        SELECT coalesce(f.query_id, v.query_id) AS query_id, coalesce(f.chunk_id, v.chunk_id) AS chunk_id, coalesce(f.doc_uid, v.doc_uid) AS doc_uid, f.rank AS fr, v.rank AS vr,
          CASE WHEN f.rank IS NOT NULL AND v.rank IS NOT NULL THEN 'hybrid' WHEN f.rank IS NOT NULL THEN 'fulltext' ELSE 'vector' END AS src
        FROM claim_fulltext f FULL JOIN claim_nearest v ON v.query_id = f.query_id AND v.chunk_id = f.chunk_id)) h JOIN claim_texts q USING (query_id) WHERE h.rank <= {LIMITS['per_query']}""",
)
part(
    "candidates",
    """SELECT claim_id, chunk_id, any_value(doc_uid) AS doc_uid, list_sort(list_distinct(list(label))) AS labels, list_sort(list_distinct(flatten(list(ms)))) AS sources,
    max(rerank_score) AS rerank_score, min(query_no) AS first_query, min({'q': query_no, 'r': rank, 's': src}).s AS src, min({'q': query_no, 'r': rank, 's': src}).r AS first_rank FROM labelled GROUP BY claim_id, chunk_id""",
)
oracle("merge_candidates", "SELECT claim_id, chunk_id, doc_uid, array_to_string(labels, '|') AS matched_queries, array_to_string(sources, '|') AS matched_sources, round(rerank_score, 6) AS rerank_score, first_query FROM candidates")
part(
    "ranked",
    """SELECT * FROM (SELECT c.*, n, row_number() OVER (PARTITION BY c.claim_id ORDER BY len(labels) DESC, len(sources) DESC, coalesce(rerank_score, 0) DESC, first_query, first_rank, chunk_id) AS rank
    FROM candidates c JOIN (SELECT claim_id, count(*) AS n FROM claim_queries GROUP BY claim_id) q USING (claim_id)) WHERE rank <= greatest(8, 2 * n)""",
)
oracle("rank_candidates", "SELECT claim_id, chunk_id, rank FROM ranked")


def counter(text: str) -> str:
    pairs = (("has_exclusive", LX.counter_exclusive), ("has_universal", LX.counter_universal), ("has_negation", LX.counter_negation), ("has_comparison", LX.counter_comparison))
    return "(" + " OR ".join(f"({f} AND {any_of(text, w)})" for f, w in pairs) + ")"


part(
    "annotated",
    f"""SELECT *, CASE WHEN NOT is_strict THEN 'support' WHEN counter THEN 'contradict' WHEN covers THEN 'support' ELSE 'insufficient' END AS relation FROM (
    SELECT r.*, k.content, k.source_span, k.doc_title, k.section_title, f.has_exclusive, f.has_universal, f.has_negation, f.has_comparison, f.is_strict, {counter('k.content')} AS counter,
      CASE WHEN has_exclusive THEN {any_of('k.content', LX.exclusive)} AND NOT {any_of('k.content', LX.counter_exclusive)}
           WHEN has_universal THEN {any_of('k.content', LX.universal)} AND NOT {any_of('k.content', LX.unless_universal)}
           WHEN has_negation THEN {any_of('k.content', LX.negation)} AND list_contains(labels, 'claim_literal')
           WHEN has_comparison THEN {any_of('k.content', LX.comparison)} AND list_contains(labels, 'claim_literal') ELSE FALSE END AS covers
    FROM ranked r JOIN (SELECT c.*, d.doc_title FROM chunks c JOIN docs d USING (doc_uid)) k USING (chunk_id) JOIN flagged_claims f USING (claim_id))""",
)
SUPPORT_REASON = "CASE " + " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in cl.REASON_SUPPORT.items()) + " END"
REASON = f"""CASE WHEN NOT is_strict THEN {lit(cl.REASON_RELATED)} WHEN counter THEN {lit(cl.REASON_CONTRADICT)} WHEN covers THEN {SUPPORT_REASON}
    WHEN list_contains(labels, 'logic_relaxed') THEN {lit(cl.REASON_RELAXED)} WHEN list_contains(labels, 'counter_probe') THEN {lit(cl.REASON_PROBE)}
    WHEN list_contains(labels, 'claim_literal') THEN {lit(cl.REASON_LITERAL)} ELSE {lit(cl.REASON_STRICT)} END"""
oracle("annotate_relations", f"SELECT claim_id, chunk_id, relation AS evidence_relation, {REASON} AS relation_reason FROM annotated")
part(
    "ordered",
    f"""SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY {rank('relation', lx.RELATION_RANK, 2)}, len(labels) DESC,
    CASE WHEN list_contains(labels, 'counter_probe') THEN 2 ELSE 0 END + CASE WHEN list_contains(labels, 'topic_focus') THEN 1 ELSE 0 END DESC, coalesce(rerank_score, 0) DESC, rank) AS order_no FROM annotated""",
)
oracle("order_evidence", "SELECT claim_id, chunk_id, order_no FROM ordered")
part(
    "selected",
    f"""SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY {rank('relation', lx.RELATION_RANK, 2)}, CASE WHEN relation = 'insufficient' THEN fill_no ELSE class_no END) AS selected_no FROM (
    SELECT *, CASE WHEN nc >= 2 THEN least(ni, 4 - c - s, 1) ELSE least(ni, 4 - c - s) END AS i FROM (
      SELECT *, least(ns, 4 - c) AS s FROM (SELECT *, least(nc, 4 - CASE WHEN nc > 0 AND ns > 0 THEN 1 ELSE 0 END) AS c FROM (
        SELECT *, count(*) FILTER (relation = 'contradict') OVER w AS nc, count(*) FILTER (relation = 'support') OVER w AS ns, count(*) FILTER (relation = 'insufficient') OVER w AS ni,
          row_number() OVER (PARTITION BY claim_id, relation ORDER BY order_no) AS class_no,
          row_number() OVER (PARTITION BY claim_id, relation ORDER BY list_contains(labels, 'claim_literal') DESC, list_contains(labels, 'counter_probe') DESC, labels = ['topic_focus'], coalesce(rerank_score, 0) DESC, order_no) AS fill_no
        FROM ordered WINDOW w AS (PARTITION BY claim_id)))))
    WHERE CASE WHEN relation = 'contradict' THEN class_no <= c WHEN relation = 'support' THEN class_no <= s ELSE fill_no <= i END""",
)
oracle("select_evidence", "SELECT claim_id, chunk_id, selected_no FROM selected")
part(
    "claim_evidence",
    """SELECT claim_id, count(*) AS evidence_count, count(*) FILTER (relation = 'contradict') AS contradict_count, count(*) FILTER (relation = 'support') AS support_count,
    bool_or(is_strict AND (relation = 'contradict' OR counter)) AS has_counter FROM selected GROUP BY claim_id""",
)
oracle("detect_counter_evidence", "SELECT * FROM claim_evidence")
part(
    "state",
    """SELECT f.*, coalesce(e.evidence_count, 0) AS evidence_count, coalesce(e.contradict_count, 0) AS contradict_count, coalesce(e.support_count, 0) AS support_count,
    coalesce(e.has_counter, FALSE) AS has_counter, l.max_level FROM flagged_claims f LEFT JOIN claim_evidence e USING (claim_id) LEFT JOIN levels l USING (claim_id)""",
)
LEAD = "'Claim“' || substr(claim_text, 1, 28) || "
TEXT = f"""CASE WHEN has_counter THEN CASE WHEN contradict_count > 0 THEN {LEAD} '”检索到 ' || contradict_count || ' 条矛盾证据，说明其排他或绝对化约束被反证。' ELSE {LEAD} '”存在明显反证线索，当前不能判定为通过。' END
    WHEN has_exclusive THEN {LEAD} '”包含“只有/唯一”类排他表述，现有证据不足以证明其唯一性。' WHEN has_universal THEN {LEAD} '”包含“所有/全部”类全称表述，现有证据不足以覆盖其全部范围。'
    WHEN has_negation THEN {LEAD} '”包含否定性约束，现有证据不足以证明该否定结论始终成立。' WHEN has_comparison THEN {LEAD} '”包含比较型结论，现有证据不足以支撑其比较优势或劣势。' END"""
part(
    "decided",
    f"""SELECT *, CASE WHEN step IN (1, 2) THEN 'rejected' WHEN step = 6 THEN 'verified' ELSE 'needs_review' END AS verdict,
    (CASE step WHEN 1 THEN 0.15 WHEN 2 THEN 0.25 WHEN 3 THEN 0.35 WHEN 4 THEN 0.55 WHEN 5 THEN CASE WHEN evidence_count > 0 THEN 0.45 ELSE 0.2 END WHEN 6 THEN 0.85 ELSE 0.2 END)::DOUBLE AS confidence,
    CASE WHEN step IN (1, 2, 3) THEN 'high' WHEN step = 5 THEN CASE WHEN has_exclusive OR has_negation THEN 'high' ELSE 'medium' END WHEN step = 6 THEN 'low' ELSE 'medium' END AS risk_level,
    CASE WHEN step IN (1, 2) THEN 'contradict' WHEN step = 6 THEN 'support' ELSE 'insufficient' END AS evidence_judgement,
    CASE step WHEN 1 THEN {lit(cl.REASON_BLOCK)} WHEN 2 THEN {TEXT} WHEN 3 THEN {lit(cl.REASON_ERROR)} WHEN 4 THEN {lit(cl.REASON_WARN)} WHEN 5 THEN {TEXT} WHEN 6 THEN {lit(cl.REASON_VERIFIED)} ELSE {lit(cl.REASON_NONE)} END AS reason
    FROM (SELECT *, CASE WHEN max_level = 'block' THEN 1 WHEN has_counter THEN 2 WHEN max_level = 'error' THEN 3 WHEN max_level = 'warn' THEN 4 WHEN is_strict THEN 5 WHEN evidence_count > 0 THEN 6 ELSE 7 END AS step FROM state)""",
)
oracle("heuristic_verdict", "SELECT check_id, claim_no, claim_id, evidence_count > 0 AS has_evidence, evidence_count, verdict, confidence, risk_level, evidence_judgement FROM decided")
oracle("heuristic_reason", "SELECT claim_id, reason FROM decided")
oracle(
    "evidence_details",
    f"""SELECT claim_id, selected_no - 1 AS p, chunk_id, doc_uid, doc_title, source_span, src AS retrieval_source, array_to_string(sources, '|') AS matched_sources, array_to_string(labels, '|') AS matched_queries,
    'chunk' AS context_mode, section_title, relation AS evidence_relation, {REASON} AS relation_reason, substr(content, 1, 300) AS content_preview FROM selected""",
)
part(
    "model",
    """SELECT claim_id, claim_no, claim_no % 7 <> 5 AS parsed, CASE claim_no % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' ELSE 'needs_review' END AS verdict,
    CASE WHEN claim_no % 2 = 0 THEN 'support' ELSE 'insufficient' END AS judgement, least(1.0, claim_no * 37 % 150 / 100.0)::DOUBLE AS confidence,
    CASE WHEN claim_no % 4 = 0 THEN 'low' ELSE 'medium' END AS risk, 'r' || claim_no AS reason FROM claims""",
)
oracle(
    "parse_model_output",
    """SELECT claim_id, parsed, CASE WHEN parsed THEN verdict END AS verdict, CASE WHEN parsed THEN judgement END AS evidence_judgement, CASE WHEN parsed THEN confidence END AS confidence,
    CASE WHEN parsed THEN risk END AS risk_level, CASE WHEN parsed THEN reason END AS reason FROM model""",
)
oracle(
    "merge_verdicts",
    f"""WITH joined AS (SELECT d.claim_id, d.verdict AS hv, d.confidence AS hc, d.risk_level AS hr, d.evidence_judgement AS hj, d.reason AS hx, d.evidence_count > 0 AS has_evidence, m.parsed, m.confidence AS mc, m.risk, m.judgement, m.reason AS mx,
      CASE WHEN m.judgement = 'contradict' THEN 'rejected' WHEN m.judgement = 'insufficient' AND m.verdict = 'verified' THEN 'needs_review' ELSE m.verdict END AS mv FROM decided d JOIN model m USING (claim_id)),
    finals AS (SELECT *, {named(f"greatest({rank('hv', lx.VERDICT_RANK, 1)}, {rank('mv', lx.VERDICT_RANK, 1)})", lx.VERDICT_RANK)} AS fv FROM joined)
    SELECT claim_id, CASE WHEN parsed THEN fv ELSE hv END AS verdict, CASE WHEN NOT parsed THEN hc WHEN fv = mv THEN mc ELSE least(mc, hc) END AS confidence,
    CASE WHEN parsed THEN {named(f"greatest({rank('hr', lx.RISK_RANK, 1)}, {rank('risk', lx.RISK_RANK, 1)})", lx.RISK_RANK)} ELSE hr END AS risk_level,
    CASE WHEN parsed THEN judgement ELSE hj END AS evidence_judgement, CASE WHEN parsed THEN mx ELSE hx END AS reason, has_evidence FROM finals""",
)
oracle(
    "coerce_enums",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'verified' ELSE 'needs_review' END AS verdict, CASE WHEN event_id % 2 = 0 THEN 'support' ELSE 'insufficient' END AS evidence_judgement FROM events",
)
YN = " || chr(10) || ".join(f"'- {n}: ' || CASE WHEN {f} THEN 'yes' ELSE 'no' END" for n, f in (("exclusive", "has_exclusive"), ("universal", "has_universal"), ("negation", "has_negation"), ("comparison", "has_comparison")))
oracle(
    "build_prompts",
    f"""SELECT f.claim_id, 'Claim: ' || f.claim_text || chr(10) || chr(10) || 'Evidence:' || chr(10) || coalesce(e.b, '- 无证据') || chr(10) || chr(10) || 'Rules:' || chr(10) || coalesce(r.b, '- 无规则命中')
    || chr(10) || chr(10) || 'Logic:' || chr(10) || {YN} || chr(10) || chr(10) || 'Answer with one JSON object.' AS prompt FROM flagged_claims f
    LEFT JOIN (SELECT claim_id, string_agg('- 文档: ' || doc_uid || ' | 位置: ' || source_span || ' | 查询来源: ' || array_to_string(labels, '/') || ' | 证据关系: ' || relation || ' | 关系说明: ' || {REASON} || ' | 内容: ' || substr(content, 1, 400), chr(10) ORDER BY selected_no) AS b FROM selected GROUP BY claim_id) e USING (claim_id)
    LEFT JOIN (SELECT claim_id, string_agg('- 规则: ' || rule_code || ' | 等级: ' || hit_level || ' | 原因: ' || hit_message, chr(10) ORDER BY rule_no) AS b FROM rule_hits GROUP BY claim_id) r USING (claim_id)""",
)
oracle("overall_verdict", "SELECT check_id, CASE WHEN bool_or(verdict = 'rejected') THEN 'rejected' WHEN bool_and(verdict = 'verified') THEN 'passed' ELSE 'needs_review' END AS overall_verdict FROM decided GROUP BY check_id")
oracle("overall_risk", f"SELECT check_id, {named('r', lx.RISK_RANK)} AS risk_level FROM (SELECT check_id, max({rank('risk_level', lx.RISK_RANK, 0)}) AS r FROM decided GROUP BY check_id)")
oracle(
    "check_summary",
    """SELECT *, '共 ' || claim_count || ' 条 claim，verified ' || verified_count || ' 条，needs_review ' || needs_review_count || ' 条，rejected ' || rejected_count || ' 条，命中规则 ' || rule_hit_count || ' 条。' AS summary FROM (
    SELECT d.check_id, count(*) AS claim_count, count(*) FILTER (verdict = 'verified') AS verified_count, count(*) FILTER (verdict = 'needs_review') AS needs_review_count, count(*) FILTER (verdict = 'rejected') AS rejected_count,
      coalesce(max(h.n), 0) AS rule_hit_count FROM decided d LEFT JOIN (SELECT check_id, count(*) AS n FROM rule_hits GROUP BY check_id) h USING (check_id) GROUP BY d.check_id)""",
)
PRESETS = ", ".join(f"({n}, {lit(p[0])}, {p[2]}, {p[3]}, {p[4]}, {p[5]}, {p[6]}, {p[7]}, {p[8]})" for n, p in enumerate(lx.CHECK_PRESETS))
D = lx.CHECK_POLICY
oracle(
    "retrieval_policy",
    f"""SELECT conv_id, turn, coalesce(name, 'other') AS template_id, coalesce(a, {D['fulltext_top_k']})::BIGINT AS fulltext_top_k, coalesce(b, {D['vector_top_k']})::BIGINT AS vector_top_k, coalesce(c, {D['final_top_k']})::BIGINT AS final_top_k,
    coalesce(d, {D['use_rerank']}) AS use_rerank, coalesce(e, {D['neighbor_window']})::BIGINT AS neighbor_window, coalesce(f, {D['include_section_context']}) AS include_section_context, coalesce(g, {D['section_max_chars']})::BIGINT AS section_max_chars
    FROM conversations LEFT JOIN (VALUES {PRESETS}) AS p(i, name, a, b, c, d, e, f, g) ON p.i = conv_id % 5""",
)
oracle(
    "verify_persisted",
    """SELECT check_id, expected_count, written_count, expected_count = written_count AS persist_verified FROM (
    SELECT check_id, count(*) AS expected_count, count(*) FILTER (substr(check_id, 2, 1) <> '9' OR claim_no > 1) AS written_count FROM claims GROUP BY check_id)""",
)


# ------------------------------------------------------------------ fine relation
def flat(x: str) -> str:
    return f"trim({no_space(x)}, {lit(rl.EDGE_MARKS)})"


TERM_SPLIT = lit("[\\s、，,。；;：:（）()《》“”\"']+")
part(
    "term_lists",
    f"""SELECT claim_id, flat_claim, {in_order('t')} AS terms FROM (
    SELECT claim_id, flat_claim, flatten(list_transform(list_filter(string_split_regex({replaces('flat_claim', [(w, ' ') for w in RX.stop_words])}, {TERM_SPLIT}), lambda v: length(v) >= 2),
      lambda v: [v] || list_filter({strings(RX.claim_term)}, lambda m: contains(v, m)))) AS t FROM (SELECT claim_id, {flat('claim_text')} AS flat_claim FROM claims))""",
)
oracle("claim_terms", "SELECT claim_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS term_no FROM term_lists")
part(
    "relation_pairs",
    f"""SELECT *, list_filter(terms, lambda v: contains(flat_evidence, v)) AS matched FROM (SELECT p.claim_id, p.chunk_id, t.flat_claim, t.terms, {flat("c.section_title || chr(10) || c.content")} AS flat_evidence
    FROM (SELECT DISTINCT claim_id, chunk_id FROM labelled) p JOIN term_lists t USING (claim_id) JOIN chunks c USING (chunk_id))""",
)
part("overlap_rows", "SELECT *, len(matched) >= 2 OR (len(matched) >= 1 AND len(terms) <= 2) AS enough FROM relation_pairs")
oracle("term_overlap", "SELECT claim_id, chunk_id AS evidence_id, len(terms) AS term_count, len(matched) AS matched_count, enough FROM overlap_rows")
SUBJECT = RX.single_item_subject[0]
WIN = "substr(flat_evidence, j, 36)"
EFFECT = f"""(contains(flat_claim, {lit(SUBJECT)}) AND len(list_filter(range(1, length(flat_evidence) + 1), lambda j: substr(flat_evidence, j, {len(SUBJECT)}) = {lit(SUBJECT)}
    AND {any_of(WIN, RX.partial_effect)} AND NOT {any_of(WIN, RX.whole_words)})) > 0)"""
oracle("subject_partial_support", f"SELECT claim_id, chunk_id AS evidence_id, {EFFECT} AS partial_support FROM overlap_rows")


def has(words) -> str:
    return any_of("flat_evidence", words)


METHOD = f"({has(RX.method_context)} AND {any_of('flat_claim', RX.single_item_subject)})"
part(
    "relations",
    f"""SELECT *, CASE WHEN flat_evidence = '' THEN 'insufficient' WHEN {has(RX.refute)} THEN CASE WHEN enough THEN 'direct_refute' ELSE 'context_only' END WHEN {has(RX.example)} THEN 'example_only'
    WHEN {METHOD} THEN CASE WHEN {EFFECT} THEN 'partial_support' ELSE 'method_or_formula_context' END
    WHEN {has(RX.condition)} AND NOT {has(RX.support)} THEN 'risk_or_condition' WHEN {has(RX.condition)} AND enough THEN 'risk_or_condition' WHEN {has(RX.support)} AND enough THEN 'direct_support'
    WHEN len(matched) > 0 THEN CASE WHEN len(matched) < greatest(2, len(terms) // 2) THEN 'context_only' ELSE 'partial_support' END ELSE 'insufficient' END AS relation_type FROM overlap_rows""",
)
LABEL = "CASE relation_type " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in lx.RELATION_LABELS.items()) + " END"
oracle(
    "classify_relation",
    f"""SELECT claim_id, chunk_id AS evidence_id, relation_type, {LABEL} AS relation_label, {LABEL} || '；命中核心词：' || CASE WHEN len(matched) > 0 THEN array_to_string(matched[:4], '、') ELSE '未覆盖核心词' END AS relation_reason FROM relations""",
)


def conclusion(kinds: str) -> str:
    c = lambda n: f"list_contains({kinds}, '{n}')"
    rest = " ".join(f"WHEN {c(n)} THEN '{n}'" for n in rl.CONCLUSION_ORDER[2:])
    return f"CASE WHEN {c('direct_refute')} THEN 'direct_refute' WHEN {c('direct_support')} THEN CASE WHEN {c('risk_or_condition')} OR {c('partial_support')} THEN 'direct_support_with_limits' ELSE 'direct_support' END {rest} ELSE 'insufficient' END"


def conclusion_text(kind: str, claim: str) -> str:
    return f"replace(CASE {kind} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in lx.CONCLUSIONS.items()) + f" END, '{{claim}}', {claim})"


oracle(
    "infer_conclusion",
    f"""SELECT claim_id, k AS conclusion_class, {conclusion_text('k', 'flat_claim')} AS conclusion FROM (SELECT t.claim_id, t.flat_claim, {conclusion('r.kinds')} AS k FROM term_lists t
    LEFT JOIN (SELECT claim_id, list(DISTINCT relation_type) AS kinds FROM relations GROUP BY claim_id) r USING (claim_id))""",
)
oracle(
    "merge_marker_rules",
    """WITH base AS (SELECT lang AS marker, list_sort(list(DISTINCT source)) AS b FROM documents GROUP BY lang),
    extra AS (SELECT lang || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'x' END AS marker, list_sort(list(DISTINCT 'w' || (doc_id % 7))) AS o FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
    SELECT coalesce(base.marker, extra.marker) AS marker, array_to_string(coalesce(b, []) || coalesce(o, []), '|') AS words FROM base FULL JOIN extra ON base.marker = extra.marker""",
)
part(
    "question_terms_flat",
    f"""SELECT item_id, flat_claim, {in_order('t')} AS terms FROM (SELECT item_id, flat_claim, flatten(list_transform(list_filter(string_split_regex({replaces('flat_claim', [(w, ' ') for w in RX.stop_words])}, {TERM_SPLIT}),
      lambda v: length(v) >= 2), lambda v: [v] || list_filter({strings(RX.claim_term)}, lambda m: contains(v, m)))) AS t FROM (SELECT item_id, {flat('text')} AS flat_claim FROM benchmark))""",
)
part(
    "kb_classified",
    f"""SELECT *, CASE WHEN flat_evidence = '' THEN 'insufficient' WHEN {has(RX.refute)} THEN CASE WHEN enough THEN 'direct_refute' ELSE 'context_only' END WHEN {has(RX.example)} THEN 'example_only'
    WHEN {METHOD} THEN CASE WHEN {EFFECT} THEN 'partial_support' ELSE 'method_or_formula_context' END
    WHEN {has(RX.condition)} AND NOT {has(RX.support)} THEN 'risk_or_condition' WHEN {has(RX.condition)} AND enough THEN 'risk_or_condition' WHEN {has(RX.support)} AND enough THEN 'direct_support'
    WHEN len(matched) > 0 THEN CASE WHEN len(matched) < greatest(2, len(terms) // 2) THEN 'context_only' ELSE 'partial_support' END ELSE 'insufficient' END AS relation_type FROM (
      SELECT *, len(matched) >= 2 OR (len(matched) >= 1 AND len(terms) <= 2) AS enough FROM (SELECT *, list_filter(terms, lambda v: contains(flat_evidence, v)) AS matched FROM (
        SELECT k.*, q.flat_claim, q.terms, {flat("k.title || chr(10) || k.content")} AS flat_evidence FROM kb_evidence k JOIN question_terms_flat q ON q.item_id = k.question_id)))""",
)
FULL = strip("content")
part(
    "answer_parts",
    f"""SELECT question_id, list(relation_type) AS kinds, bool_or({any_of('content', RX.caution)}) AS caution,
    string_agg({LABEL} || '：' || title, '；' ORDER BY position_no) FILTER (position_no <= 4) AS judgement,
    string_agg(CASE WHEN length({FULL}) > 180 THEN {f"rtrim(substr({FULL}, 1, 180), ' ' || chr(10) || chr(9) || chr(13))"} || '...' ELSE {FULL} END, '；' ORDER BY position_no) FILTER (position_no <= 4) AS points,
    string_agg(title || '（' || coalesce(nullif(source_anchor, ''), position) || '），文档：' || doc_uid, '；' ORDER BY position_no) FILTER (position_no <= 4) AS sources FROM kb_classified GROUP BY question_id""",
)
NN = " || chr(10) || chr(10) || "
oracle(
    "compose_local_answer",
    f"""SELECT b.item_id AS question_id, CASE WHEN a.question_id IS NULL THEN '结论：证据不足，不能回答“' || b.text || '”。'{NN}'依据：未在当前知识库的 PageIndex 结构或原文片段中找到直接相关证据。'{NN}'来源：无。'{NN}'不确定点：需要补充相关文档或重新构建索引后再判断。'
    ELSE '结论：' || {conclusion_text(conclusion('a.kinds'), 'q.flat_claim')}{NN}'证据判断：' || a.judgement{NN}'依据：' || a.points{NN}'来源：' || a.sources{NN}'不确定点：' ||
      CASE WHEN a.caution THEN '现有证据没有提供针对具体疾病人群的明确疗效结论，且涉及用药指导或禁忌，不能替代医生判断。' ELSE '本地降级回答只基于当前命中的文档证据，未做外部医学事实补充。' END END AS answer
    FROM benchmark b JOIN question_terms_flat q USING (item_id) LEFT JOIN answer_parts a ON a.question_id = b.item_id""",
)
oracle(
    "structure_context",
    """SELECT question_id, string_agg(doc_uid || ' > ' || title || ' > ' || coalesce(nullif(source_anchor, ''), position), chr(10) ORDER BY position_no) AS context FROM kb_evidence WHERE position_no <= 5 GROUP BY question_id""",
)
P = rl.PLAN_DEFAULTS
oracle(
    "normalize_question_plan",
    f"""SELECT conv_id || '-' || turn AS question_id, CASE WHEN conv_id % 4 = 0 THEN 'summary' ELSE 'unknown' END AS question_type, {lit(P['answer_strategy'])} AS answer_strategy,
    CASE WHEN conv_id % 4 = 0 THEN 't' || conv_id ELSE {strip('text')} END AS target, CASE WHEN conv_id % 4 = 1 THEN 'c' ELSE '' END AS claim, {lit(P['insufficient_evidence_policy'])} AS insufficient_evidence_policy,
    CASE WHEN conv_id % 4 = 0 THEN 'a|b' ELSE {lit('|'.join(rl.PLAN_OUTPUT))} END AS required_output, conv_id % 4 <> 1 AS needs_evidence_relation FROM conversations""",
)
