"""Comparison SQL: text normalisation and query building."""

from __future__ import annotations

from verification import inputs as vi
from verification.sql.base import SPACES, any_of, lit, no_space, oracle, part, replaces, squeeze, strip
from verification.sql.s_structure import COMPACT

LX, QX, DX = vi.LOGIC, vi.QUESTION, vi.DICTIONARY
MARKS = lit("[，。！？；：、“”‘’\"'（）()\\[\\]{}<>《》]+")


def norm(x: str) -> str:
    return squeeze(replaces(replaces(x, DX.variant_pairs), DX.alias_pairs))


def in_order(x: str) -> str:
    """Distinct values of a list column in first-seen order (x must be a plain name)."""
    return f"list_filter({x}, lambda v, k: list_position({x}, v) = k)"


def non_empty(x: str) -> str:
    return f"list_filter({x}, lambda v: v <> '')"


def tokens(x: str) -> str:
    return non_empty(f"string_split({x}, ' ')")


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]::VARCHAR[]"


def expansion_list(o: str, n: str) -> str:
    parts = [f"[{o}, {n}]"]
    for canonical, aliases in DX.entities:
        made = ", ".join(f"replace({n}, {lit(canonical)}, {lit(a)})" for a in aliases)
        parts.append(f"(CASE WHEN contains({n}, {lit(canonical)}) THEN [{made}] ELSE [] END)")
    return f"list_transform({' || '.join(parts)}, lambda v: {squeeze('v')})"


def expansion_rows(source: str, limit: int) -> str:
    """(key, variant_no, text) of a (key, t) source."""
    return f"""SELECT key, unnest(u) AS text, generate_subscripts(u, 1) AS variant_no FROM (
      SELECT key, ({in_order('e')})[:{limit}] AS u FROM (SELECT key, {non_empty(expansion_list('o', 'n'))} AS e FROM (
        SELECT key, o, {norm('o')} AS n FROM (SELECT key, {squeeze('t')} AS o FROM ({source})) WHERE o <> '')))"""


part(
    "queries_in",
    f"""SELECT 'b' || item_id AS query_id, text, item_id FROM benchmark UNION ALL
    SELECT 'k' || item_id, array_to_string(list_transform(list_sort(list_transform(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')),
      lambda w: length(w) >= 5), lambda w: {{'n': length(w), 'w': w}}))[:2], lambda s: s.w), ' '), item_id FROM benchmark""",
)
oracle("normalize_terms", f"SELECT chunk_id AS query_id, {norm('content')} AS normalized FROM chunks")
part("variants", "SELECT key AS query_id, variant_no, text FROM (" + expansion_rows("SELECT query_id AS key, text AS t FROM queries_in", 6) + ")")
oracle("expand_queries", "SELECT query_id, variant_no, text FROM variants")
part("index_texts", f"SELECT *, CASE WHEN o = n THEN o ELSE o || chr(10) || n END AS index_text FROM (SELECT *, {squeeze('content')} AS o, {norm('content')} AS n FROM chunks)")
oracle("build_index_text", "SELECT chunk_id, index_text FROM index_texts")


def search_text(x: str) -> str:
    cleaned = f"translate({x}, chr(13) || chr(10) || '，,；;、|' || chr(9), '         ')"
    return f"array_to_string(list_filter(string_split({cleaned}, ' '), lambda v: {strip('v')} <> ''), ' ')"


oracle("normalize_search_query", f"SELECT doc_id AS query_id, {search_text('text')} AS search_text FROM documents")


def overlap_terms(x: str) -> str:
    low = f"lower({x})"
    splitter = f"{SPACES[:-3]}，。！？；：、“”‘’\"''（）()\\[\\]{{}}<>《》]+'"
    return f"list_distinct(regexp_extract_all({low}, '[a-z0-9_]{{2,}}') || list_filter(string_split_regex({low}, {splitter}), lambda v: length(v) >= 2))"


oracle("tokenize_overlap", f"SELECT doc_id, unnest({overlap_terms('text')}) AS term FROM documents")
ESC = lambda x: replaces(x, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")])
oracle(
    "highlight_terms",
    f"""WITH first_turn AS (SELECT conv_id, array_to_string(string_split({search_text('text')}, ' ')[:3], ';') AS query FROM conversations WHERE turn = 0),
    terms AS (SELECT conv_id, t, row_number() OVER (PARTITION BY conv_id ORDER BY length(t) DESC, k) AS r FROM (
      SELECT conv_id, t, min(k) AS k FROM (SELECT conv_id, unnest(l) AS t, generate_subscripts(l, 1) AS k FROM (
        SELECT conv_id, {tokens(squeeze(search_text('query')))} AS l FROM first_turn)) GROUP BY conv_id, t)),
    three AS (SELECT conv_id, max(t) FILTER (r = 1) AS a, max(t) FILTER (r = 2) AS b, max(t) FILTER (r = 3) AS c FROM terms GROUP BY conv_id)
    SELECT conv_id, turn, h AS highlighted FROM (SELECT c.conv_id, c.turn, {ESC('c.text')} AS h0, {ESC('a')} AS ea, {ESC('b')} AS eb, {ESC('c')} AS ec,
      replace(h0, ea, '<mark>' || ea || '</mark>') AS h1, CASE WHEN eb IS NULL THEN h1 ELSE replace(h1, eb, '<mark>' || eb || '</mark>') END AS h2,
      CASE WHEN ec IS NULL THEN h2 ELSE replace(h2, ec, '<mark>' || ec || '</mark>') END AS h
      FROM conversations c JOIN three USING (conv_id))""".replace("{ESC('c')}", "").replace(ESC("c"), ESC("three.c")).replace(ESC("a"), ESC("three.a")).replace(ESC("b"), ESC("three.b")),
)

part(
    "texts_in",
    f"""SELECT 'c' || conv_id || '-' || turn AS check_id, text AS input_text, 'src' || (conv_id % 20) AS knowledge_base_id, conv_id,
    {vi.EPOCH} + conv_id * 3600 + turn * 60 AS created_s FROM conversations""",
)
part(
    "claims",
    f"""SELECT check_id, knowledge_base_id, conv_id, claim_no, claim_text, sha256(check_id || ':' || claim_no) AS claim_id FROM (
    SELECT check_id, knowledge_base_id, conv_id, unnest(p) AS claim_text, generate_subscripts(p, 1) AS claim_no FROM (
      SELECT check_id, knowledge_base_id, conv_id, CASE WHEN len(l) > 0 THEN l ELSE [{strip('input_text')}] END AS p FROM (
        SELECT *, {non_empty(f"list_transform(string_split(translate(input_text, '；;' || chr(10), '。。。'), '。'), lambda v: {strip('v')})")} AS l FROM texts_in)))""",
)


def plain(x: str) -> str:
    return squeeze(f"regexp_replace({x}, {MARKS}, ' ', 'g')")


def drop(x: str, values) -> str:
    return replaces(x, [(v, " ") for v in values])


part("loose_claims", f"SELECT *, {plain(drop('claim_text', LX.logic_words))} AS relaxed, {strip('claim_text')} AS literal FROM claims")
oracle("strip_logic_words", "SELECT claim_id, relaxed FROM loose_claims")


def topic(source: str) -> str:
    """(key, topic) of a (key, t) source."""
    return f"""SELECT key, CASE WHEN len(parts) < 2 THEN {plain('cut')} WHEN array_to_string(two, ' ') = {plain('t')} THEN array_to_string(two, '') ELSE array_to_string(two, ' ') END AS topic FROM (
      SELECT *, CASE WHEN len(longer) >= 2 THEN longer[:2] ELSE parts[:2] END AS two FROM (
        SELECT *, list_filter(parts, lambda v: length(v) > 1) AS longer FROM (
          SELECT *, {tokens(squeeze('cut'))} AS parts FROM (SELECT key, t, {drop('t', LX.topic_phrases)} AS cut FROM ({source})))))"""


oracle("topic_focus", f"SELECT key AS claim_id, topic FROM ({topic('SELECT claim_id AS key, relaxed AS t FROM loose_claims')})")


def keywords(source: str) -> str:
    """(t, kw list) of a (t) source."""
    ends = "|".join(LX.entity_ends)
    return f"""SELECT t, CASE WHEN q = '' OR contains(q, ' ') OR len(terms) = 0 THEN []::VARCHAR[] ELSE
        (CASE WHEN length(entity) >= 2 THEN flatten(list_transform(rel, lambda w: [entity || ' ' || w, w])) ELSE [] END)
        || (CASE WHEN terms[1] <> terms[-1] THEN [terms[1] || ' ' || terms[-1]] ELSE [] END) || [terms[-1]]
        || (CASE WHEN len(rel) > 0 THEN [terms[1] || ' ' || rel[1]] ELSE [] END) END AS kw FROM (
      SELECT *, CASE WHEN len(parts) > 0 THEN parts WHEN len(rel) > 0 THEN list_filter(string_split({replaces('rest', [(w, chr(1)) for w in LX.relation_words])}, chr(1)), lambda v: length(v) >= 2)
        ELSE [] END AS terms FROM (
        SELECT *, list_filter(list_transform({tokens('rest')}, lambda v: CASE WHEN length(v) >= 2 THEN {squeeze(drop('v', LX.relation_words))} ELSE '' END),
          lambda v: length(v) >= 2 AND NOT list_contains(rel, v)) AS parts FROM (
          SELECT t, q, {plain(drop('q', LX.stop_phrases))} AS rest, list_filter({strings(LX.relation_words)}, lambda w: contains(q, w)) AS rel,
            {no_space(f"regexp_extract(q, '^(.{{2,12}}?)(?:{ends})', 1)")} AS entity FROM (SELECT t, {plain('t')} AS q FROM ({source})))))"""


oracle(
    "keyword_focus",
    f"""WITH src AS (SELECT claim_id, replace(claim_text, ' ', '') AS t FROM claims), made AS ({keywords('SELECT DISTINCT t FROM src')})
    SELECT claim_id, unnest(kw) AS keyword_query, generate_subscripts(kw, 1) AS keyword_no FROM src JOIN made USING (t)""",
)
FLAGS = f"""{any_of('claim_text', LX.exclusive)} AS has_exclusive, {any_of('claim_text', LX.universal)} AS has_universal,
    {any_of('claim_text', LX.negation)} AS has_negation, {any_of('claim_text', LX.comparison)} AS has_comparison"""
part("flagged_claims", f"SELECT *, has_exclusive OR has_universal OR has_negation OR has_comparison AS is_strict FROM (SELECT *, {FLAGS} FROM loose_claims)")


def probe(q: str) -> str:
    base = plain(q)
    return f"""CASE WHEN {base} = '' OR NOT is_strict THEN '' WHEN has_exclusive THEN {base} || ' {LX.probe_exclusive}' WHEN has_universal THEN {base} || ' {LX.probe_universal}'
    WHEN has_negation THEN {base} || ' {LX.probe_negation}' ELSE {base} || ' {LX.probe_comparison}' END"""


oracle("counter_probe", f"SELECT claim_id, {probe('relaxed')} AS probe FROM flagged_claims")
part("claim_base", f"SELECT *, CASE WHEN relaxed = '' THEN literal ELSE relaxed END AS base, {norm('relaxed')} AS norm_relaxed FROM flagged_claims")
part("base_variants", expansion_rows("SELECT claim_id AS key, base AS t FROM claim_base", 4))
part("literal_variants", expansion_rows("SELECT claim_id AS key, literal AS t FROM claim_base", 4))
part("kw_made", keywords("SELECT text AS t FROM base_variants UNION SELECT norm_relaxed FROM claim_base"))
part(
    "query_specs",
    f"""SELECT claim_id, 1 AS o1, 0 AS o2, 0 AS o3, 'claim_literal' AS label, literal AS text FROM claim_base
    UNION ALL SELECT key, 2, variant_no, 0, 'entity_expanded', text FROM literal_variants WHERE variant_no > 1
    UNION ALL SELECT claim_id, 3, 0, 0, 'logic_relaxed', relaxed FROM claim_base WHERE relaxed <> '' AND relaxed <> literal
    UNION ALL SELECT claim_id, 4, 0, 0, 'entity_expanded', norm_relaxed FROM claim_base WHERE norm_relaxed <> '' AND norm_relaxed <> relaxed
    UNION ALL SELECT key, 5, 0, 0, 'topic_focus', topic FROM ({topic('SELECT claim_id AS key, base AS t FROM claim_base')})
    UNION ALL SELECT key, 6, variant_no, k, 'keyword_focus', w FROM (SELECT key, variant_no, unnest(kw) AS w, generate_subscripts(kw, 1) AS k FROM base_variants b JOIN kw_made m ON m.t = b.text)
    UNION ALL SELECT claim_id, 7, 0, k, 'keyword_focus', w FROM (SELECT claim_id, unnest(kw) AS w, generate_subscripts(kw, 1) AS k FROM claim_base b JOIN kw_made m ON m.t = b.norm_relaxed)
    UNION ALL SELECT claim_id, 8, 0, 0, 'counter_probe', {probe('base')} FROM claim_base""",
)
part(
    "claim_queries",
    f"""SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY o1, o2, o3) AS query_no, label, text FROM (
    SELECT *, row_number() OVER (PARTITION BY claim_id, text ORDER BY o1, o2, o3) AS r FROM (SELECT claim_id, o1, o2, o3, label, {strip('text')} AS text FROM query_specs) WHERE text <> '') WHERE r = 1""",
)
oracle("build_retrieval_queries", "SELECT claim_id, query_no, label, text FROM claim_queries")


def generic_tree(x: str) -> str:
    n = COMPACT(x)
    noise = " OR ".join([f"starts_with({n}, {lit(p)})" for p in QX.noisy_prefixes] + [f"ends_with({n}, {lit(p)})" for p in QX.noisy_suffixes])
    return f"(length({n}) < 2 OR list_contains({strings(QX.generic_tree)}, {n}) OR (length({n}) <= 4 AND ({noise})))"


def generic_chunk(x: str) -> str:
    n = COMPACT(x)
    rest = f"replace({n}, {lit(QX.subject)}, '')"
    return f"""(length({n}) > {QX.max_chunk_term} OR contains({n}, {lit(QX.particle)}) OR starts_with({n}, {lit(QX.chunk_prefix)}) OR {any_of(n, QX.noisy_chunk)}
      OR list_contains({strings(QX.generic_chunk)}, {n}) OR {rest} = '' OR list_contains({strings(QX.generic_chunk)}, {rest}))"""


def meaningful(s: str) -> str:
    parts = [f"[{s}]"]
    for phrase, extra, shortest in QX.expansions:
        parts.append(f"(CASE WHEN contains({s}, {lit(phrase)}) AND length({s}) >= {shortest} THEN {strings(extra)} ELSE []::VARCHAR[] END)")
    return f"list_filter({' || '.join(parts)}, lambda v: NOT {generic_tree('v')})"


def question_terms(source: str) -> str:
    """(key, q, terms) of a (key, q) source."""
    return f"""SELECT key, q, CASE WHEN len(spaced) > 1 THEN spaced ELSE (start || list_filter(fresh, lambda v: NOT list_contains(start, v)))[:24] END AS terms FROM (
      SELECT *, {in_order('more')} AS fresh FROM (
        SELECT *, (CASE WHEN len(spaced) = 1 AND spaced[1] = flat AND {any_of('flat', QX.compact_markers)} THEN []::VARCHAR[] ELSE spaced END)
          || (CASE WHEN contains(flat, {lit(QX.subject)}) THEN [{lit(QX.subject)}] ELSE [] END) AS start,
          flatten(list_transform(list_filter({tokens(squeeze(drop('flat', QX.cut_phrases)))}, lambda s: length(s) >= 2), lambda s: {meaningful('s')})) AS more FROM (
          SELECT key, q, list_filter({tokens(squeeze("translate(q, '，？?', '   ')"))}, lambda v: length(v) >= 2) AS spaced,
            regexp_replace(q, {lit('[，。！？、,.?？' + chr(92) + 's' + chr(28) + chr(29) + chr(30) + chr(31) + chr(0x85) + chr(0xa0) + chr(0x3000) + ']')}, '', 'g') AS flat FROM ({source}))))"""


oracle(
    "extract_question_terms",
    f"""SELECT key AS question_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS term_no FROM (
    {question_terms("SELECT 's' || item_id AS key, text AS q FROM benchmark UNION ALL SELECT 'u' || item_id, replace(text, ' ', '') FROM benchmark")})""",
)
part("question_lists", question_terms("SELECT item_id AS key, text AS q FROM benchmark"))
part(
    "question_rows",
    f"""SELECT key, q, term, k FROM (SELECT key, q, {strip('t')} AS term, min(k) AS k FROM (
    SELECT key, q, unnest(terms) AS t, generate_subscripts(terms, 1) AS k FROM question_lists) GROUP BY 1, 2, 3) WHERE term <> ''""",
)
part(
    "tree_rows",
    f"""SELECT * FROM (SELECT key AS question_id, term, row_number() OVER (PARTITION BY key ORDER BY length(term) DESC, k) AS term_no FROM question_rows WHERE NOT {generic_tree('term')})
    WHERE term_no <= 16""",
)
part("term_variants", expansion_rows("SELECT DISTINCT term AS key, term AS t FROM question_rows", 8))
part(
    "term_wide",
    f"""SELECT term, {in_order('c')} AS cand FROM (SELECT term, (CASE WHEN {generic_chunk('term')} THEN [term] ELSE [term] || coalesce(e, []) END) || {meaningful('term')} AS c FROM (
      SELECT q.term, v.e FROM (SELECT DISTINCT term FROM question_rows) q LEFT JOIN (
        SELECT key, {non_empty("flatten(list(string_split(text, ' ') ORDER BY variant_no))")} AS e FROM term_variants GROUP BY key) v ON v.key = q.term))""",
)
part(
    "term_found",
    f"""SELECT q.key, row_number() OVER (PARTITION BY q.key ORDER BY q.k) AS i, count(*) OVER (PARTITION BY q.key) AS n, q.term,
    list_filter(w.cand, lambda v: (contains({COMPACT('q.q')}, {COMPACT('q.term')}) OR contains({COMPACT('q.q')}, {COMPACT('v')})) AND NOT {generic_chunk('v')}) AS cand
    FROM question_rows q JOIN term_wide w USING (term)""",
)
part(
    "term_fold",
    """RECURSIVE SELECT DISTINCT key, 0::BIGINT AS i, n, []::VARCHAR[] AS acc FROM term_found
    UNION ALL SELECT f.key, t.i, f.n, CASE WHEN list_contains(f.acc, t.term) THEN f.acc ELSE f.acc || list_filter(t.cand, lambda v: NOT list_contains(f.acc, v)) END
    FROM term_fold f JOIN term_found t ON t.key = f.key AND t.i = f.i + 1""",
)
part(
    "chunk_rows",
    """SELECT * FROM (SELECT key AS question_id, term, row_number() OVER (PARTITION BY key ORDER BY length(term) DESC, k) AS term_no FROM (
    SELECT key, unnest(acc) AS term, generate_subscripts(acc, 1) AS k FROM term_fold WHERE i = n)) WHERE term_no <= 8""",
)
oracle(
    "filter_generic_terms",
    "SELECT question_id, 'tree' AS purpose, term_no, term FROM tree_rows UNION ALL SELECT question_id, 'chunk', term_no, term FROM chunk_rows",
)
