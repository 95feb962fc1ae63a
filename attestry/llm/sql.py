"""DuckDB SQL of the queries that SQL can express."""

_WORDS = r"'[^\x20\x09-\x0D]+'"
_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
# 20 bits of a SHA-1 are 5 hex digits and 4 base32 digits.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha1(payload), CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31), 1)), '')"
_FIELDS = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "{n}", "text"))
# The polynomial's eight shifts for each byte.
_CRC32 = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"

ORACLE: dict[str, str] = {
    "op8_delta_rollup": f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy FROM documents),
c AS (SELECT source, lang, CASE WHEN lang = 'fr' THEN 'chars4-1' ELSE 'words-1' END AS tokenizer,
             CASE WHEN lang = 'fr' THEN CAST(ceil(length(text) / 4.0) AS BIGINT) ELSE len(regexp_extract_all(text, {_WORDS})) END AS n
      FROM d WHERE NOT coalesce(copy, FALSE))
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL""",
    "op9_snapshot_collapse": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns, list(role || chr(1) || text ORDER BY place) AS turns,
             string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY place) AS rendered FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, count(*) AS n_logged, turns, any_value(n_turns) AS n_turns, any_value(rendered) AS rendered FROM c GROUP BY turns),
p AS (SELECT DISTINCT k, md5(array_to_string(turns[1:k], chr(2))) AS h FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM u))
SELECT conv_id, n_turns, n_logged, rendered FROM u
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = u.n_turns AND p.h = md5(array_to_string(u.turns, chr(2))))""",
    "op11_ranked_search": f"""
WITH w AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN t USING (term) JOIN n USING (doc_id), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20""",
    "op12_warc_segments": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, sha256({_FIELDS.format(n="n_chars")}) AS leaf,
         CASE WHEN {_CRC32} % 7 = 0 AND n_chars IS NOT NULL THEN sha256({_FIELDS.format(n="(n_chars + 1)")}) ELSE sha256({_FIELDS.format(n="n_chars")}) END AS seen,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM (SELECT DISTINCT lang FROM l)),
t AS (SELECT k, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY k) AS n FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang
      UNION ALL
      SELECT k, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY k, level, pos // 2, n),
b AS (SELECT 0 AS level, k AS pos, node, count(*) OVER () AS n FROM t WHERE n = 1
      UNION ALL
      SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM b WHERE n > 1 GROUP BY level, pos // 2, n),
h AS (SELECT k, max(level) AS height FROM t GROUP BY k),
u AS (SELECT k, level, pos, node, n FROM t WHERE n > 1
      UNION ALL
      SELECT h.k, b.level + height, b.pos, b.node, b.n FROM b, h WHERE b.n > 1),
f AS (SELECT doc_id, l.lang, g.k, leaf, seen AS folded, '' AS siblings, 0 AS level, pos, height FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang JOIN h USING (k)
      UNION ALL
      SELECT doc_id, lang, f.k, leaf, sha256(CASE WHEN o.pos < p.pos THEN coalesce(o.node, '') || folded ELSE folded || coalesce(o.node, '') END),
             siblings || coalesce(o.node, ''), f.level + 1, p.pos // 2, height
      FROM (SELECT *, CASE WHEN level = height THEN k ELSE pos END AS place FROM f) f
      JOIN u p ON p.k = f.k AND p.level = f.level AND p.pos = place
      LEFT JOIN u o ON o.k = f.k AND o.level = f.level AND o.pos = xor(place, 1)),
r AS (SELECT node AS root FROM b WHERE n = 1),
e AS (SELECT doc_id, k, max(level) AS level FROM f GROUP BY doc_id, k)
SELECT doc_id, leaf, s.node AS subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM f JOIN e USING (doc_id, k, level) JOIN (SELECT k, node FROM t WHERE n = 1) s USING (k), r""",
}
