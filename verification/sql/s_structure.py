"""Comparison SQL: document structure, written with lines and windows."""

from __future__ import annotations

from verification import inputs as vi
from verification.sql.base import SPACES, WS, line_list, lit, no_space, oracle, part, squeeze, strip

part(
    "docs",
    f"""SELECT 'd' || lpad(doc_id::VARCHAR, 9, '0') AS doc_uid, source AS knowledge_base_id, 'doc_' || doc_id AS doc_id,
    'Document ' || doc_id AS doc_title, CASE WHEN doc_id % 5 <> 0 THEN 'author ' || (doc_id % 7) END AS author,
    CASE WHEN doc_id % 3 <> 0 THEN lang END AS source_name, lang, source,
    CASE WHEN doc_id % 11 = 0 THEN '[broken' WHEN doc_id % 4 <> 0 THEN '["' || lang || '","' || source || '"]' END AS tags_json,
    source || '/doc_' || doc_id || '.md' AS source_path, md AS content,
    CASE WHEN doc_id % 23 = 0 THEN 'failed' ELSE 'completed' END AS ingest_status,
    CASE WHEN doc_id % 13 = 0 THEN 'pending' WHEN doc_id % 17 = 0 THEN 'partial_failed' ELSE 'indexed' END AS index_status,
    {vi.EPOCH} + doc_id * 60 AS created_s, {vi.EPOCH} + doc_id * 60 + (doc_id * 7919) % 5003 AS updated_s, doc_id AS n
    FROM documents JOIN md_text USING (doc_id)""",
)
part(
    "md_text",
    """SELECT doc_id, string_agg(CASE WHEN i%12=1 THEN '# '||l WHEN i%12=5 THEN '## '||l
  WHEN i%12 IN (7,8) THEN '- '||l WHEN i%12=10 THEN '> '||l WHEN i%12=11 THEN chr(10)||l
  ELSE l END, chr(10) ORDER BY i) AS md
FROM (SELECT doc_id, unnest(string_split(text,chr(10))) l,
             generate_subscripts(string_split(text,chr(10)),1) i FROM documents) GROUP BY doc_id""",
)
part(
    "lines",
    f"""SELECT doc_uid, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
    FROM (SELECT doc_uid, {line_list('content')} AS l FROM docs)""",
)
oracle("explode_lines", "SELECT doc_uid, line_no::BIGINT AS line_no, line FROM lines")

part(
    "marked_lines",
    f"""SELECT *, sum(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_uid ORDER BY line_no) AS g
    FROM (SELECT *, starts_with(s, '#') AS is_h FROM (SELECT *, {strip('line')} AS s FROM lines))""",
)
part(
    "segments",
    f"""SELECT m.doc_uid, g, min(line_no) AS lo, max(line_no) AS hi,
    coalesce(max(CASE WHEN is_h THEN length(s) - length(ltrim(s, '#')) END), 1) AS level,
    coalesce(nullif(max(CASE WHEN is_h THEN {strip("ltrim(s, '#')")} END), ''), any_value(d.doc_title)) AS title,
    trim(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_h), ''), {WS}) AS body,
    count(*) FILTER (NOT is_h) AS n_body
    FROM marked_lines m JOIN docs d ON d.doc_uid = m.doc_uid GROUP BY m.doc_uid, g""",
)
part(
    "kept_segments",
    """SELECT *, CASE WHEN kept THEN row_number() OVER (PARTITION BY doc_uid, kept ORDER BY g) END AS section_no FROM (
    SELECT *, g = first_g OR (g > first_g AND body <> '') AS kept FROM (
      SELECT *, min(CASE WHEN n_body > 0 OR g = last_g THEN g END) OVER (PARTITION BY doc_uid) AS first_g FROM (
        SELECT *, max(g) OVER (PARTITION BY doc_uid) AS last_g FROM segments)))""",
)
part(
    "entries",
    """SELECT doc_uid, g, level, title, section_no FROM kept_segments WHERE g > 0
    UNION ALL SELECT d.doc_uid, 0, 1, d.doc_title, (SELECT k.section_no FROM kept_segments k WHERE k.doc_uid = d.doc_uid AND k.g = 0) FROM docs d""",
)
part(
    "enclosing",
    """SELECT a.doc_uid, a.g, e.g AS eg, e.title, e.section_no FROM kept_segments a JOIN entries e ON e.doc_uid = a.doc_uid AND e.g <= a.g
    WHERE a.kept AND NOT EXISTS (SELECT 1 FROM entries m WHERE m.doc_uid = a.doc_uid AND m.g > e.g AND m.g <= a.g AND m.level <= e.level)""",
)
part(
    "sections",
    """SELECT k.doc_uid, d.knowledge_base_id, k.section_no, p.parent_no, p.path AS heading_path, p.depth, k.title AS section_title, k.level AS section_level,
    CASE WHEN k.g = 0 THEN 1 ELSE k.lo END AS source_start_line, k.hi AS source_end_line,
    'L' || (CASE WHEN k.g = 0 THEN 1 ELSE k.lo END) || '-L' || k.hi AS source_anchor,
    'section-' || k.section_no AS source_span, CASE WHEN k.body = '' THEN k.title ELSE k.body END AS content,
    sha256(k.doc_uid || ':s:' || k.section_no) AS section_id,
    CASE WHEN p.parent_no IS NOT NULL THEN sha256(k.doc_uid || ':s:' || p.parent_no) END AS parent_section_id
    FROM kept_segments k JOIN docs d USING (doc_uid) JOIN (
      SELECT doc_uid, g, string_agg(title, ' > ' ORDER BY eg) FILTER (title <> '') AS path, count(*) AS depth,
             max(section_no) FILTER (eg < g) AS parent_no FROM enclosing GROUP BY doc_uid, g) p ON p.doc_uid = k.doc_uid AND p.g = k.g
    WHERE k.kept""",
)
oracle(
    "parse_sections",
    """SELECT doc_uid, knowledge_base_id, section_no::BIGINT AS section_no, section_id, parent_section_id, section_title, section_level::BIGINT AS section_level,
    heading_path, source_start_line::BIGINT AS source_start_line, source_end_line::BIGINT AS source_end_line, source_anchor, source_span, content FROM sections""",
)
oracle("heading_path", "SELECT doc_uid, section_no::BIGINT AS section_no, section_level::BIGINT AS section_level, heading_path FROM sections")
oracle(
    "section_tree",
    """SELECT doc_uid, section_no::BIGINT AS section_no, parent_no::BIGINT AS parent_no, section_title, depth::BIGINT AS depth,
    row_number() OVER (PARTITION BY doc_uid ORDER BY source_start_line) AS preorder FROM sections""",
)

KIND = """CASE WHEN s = '' THEN 'blank' WHEN starts_with(s, '```') OR starts_with(s, '~~~') THEN 'fenced_code'
    WHEN starts_with(s, '>') THEN 'blockquote' WHEN starts_with(s, '|') AND ends_with(s, '|') THEN 'table'
    WHEN starts_with(s, '- ') OR starts_with(s, '* ') OR starts_with(s, '+ ') OR regexp_matches(s, '^[0-9]+\\. ') THEN 'list' ELSE 'paragraph' END"""
oracle("classify_lines", f"SELECT doc_uid, line_no::BIGINT AS line_no, {KIND} AS kind FROM marked_lines")


def fenced(source: str, keys: str) -> str:
    """Fence parity and kind of the lines of a (keys…, n, line) source."""
    return f"""SELECT *, CASE WHEN inside THEN 'fenced_code' ELSE {KIND} END AS kind FROM (
      SELECT *, coalesce(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside
      FROM (SELECT *, starts_with(s, '```') OR starts_with(s, '~~~') AS f FROM (SELECT *, {strip('line')} AS s FROM ({source}))))"""


oracle(
    "fence_state",
    "SELECT doc_uid, n::BIGINT AS line_no, inside AS in_fence, kind FROM ("
    + fenced(
        f"""SELECT doc_uid, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (
        SELECT doc_uid, {line_list("replace(content, chr(10) || '- ', chr(10) || '```' || chr(10))")} AS l FROM docs)""",
        "doc_uid",
    )
    + ")",
)
part(
    "section_lines",
    fenced(
        f"SELECT doc_uid, section_no, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_uid, section_no, {line_list('content')} AS l FROM sections)",
        "doc_uid, section_no",
    ),
)
part(
    "blocks",
    f"""SELECT doc_uid, section_no, row_number() OVER (PARTITION BY doc_uid, section_no ORDER BY b) AS block_no, kind, text FROM (
    SELECT doc_uid, section_no, b, min(kind) AS kind, {strip('string_agg(line, chr(10) ORDER BY n)')} AS text FROM (
      SELECT *, sum(opens) OVER (PARTITION BY doc_uid, section_no ORDER BY n) AS b FROM (
        SELECT *, CASE WHEN n = 1 OR (NOT inside AND (lag(kind) OVER w <> kind OR (lag(f) OVER w AND lag(inside) OVER w))) THEN 1 ELSE 0 END AS opens
        FROM section_lines WINDOW w AS (PARTITION BY doc_uid, section_no ORDER BY n)))
    GROUP BY doc_uid, section_no, b) WHERE kind <> 'blank' AND text <> ''""",
)
oracle("split_blocks", "SELECT doc_uid, section_no::BIGINT AS section_no, block_no, kind, text FROM blocks")


def windows(text: str, size: int, overlap: int) -> str:
    step = size - overlap
    return (
        f"list_filter(list_transform(range(0, 1 + ceil(greatest(length({text}) - {size}, 0) / {step}.0)::BIGINT), "
        f"lambda j: {strip(f'substr({text}, 1 + j * {step}, {size})')}), lambda x: x <> '')"
    )


def splittable(text: str, size: int) -> str:
    first = strip(f"{line_list(text)}[1]")
    return f"(length({text}) > {size} AND NOT regexp_matches({first}, '^(>|\\||```|~~~|[-*+] )') AND NOT regexp_matches({first}, '^[0-9]+\\. '))"


oracle(
    "split_by_length",
    f"""SELECT doc_uid, section_no::BIGINT AS section_no, block_no, unnest(w) AS window_text, generate_subscripts(w, 1) AS window_no
    FROM (SELECT *, {windows('text', 120, 30)} AS w FROM blocks WHERE {splittable('text', 120)})""",
)
part("sized_blocks", f"SELECT *, {splittable('text', 500)} AS cut, {windows('text', 500, 100)} AS w FROM blocks")
part(
    "packing",
    f"""RECURSIVE SELECT doc_uid, section_no, 0::BIGINT AS block_no, count(*) AS n, '' AS cur, []::VARCHAR[] AS done FROM sized_blocks GROUP BY doc_uid, section_no
    UNION ALL SELECT p.doc_uid, p.section_no, b.block_no, p.n,
      CASE WHEN b.cut THEN '' WHEN p.cur = '' THEN b.text WHEN length(p.cur) + 2 + length(b.text) <= 500 THEN p.cur || chr(10) || chr(10) || b.text ELSE b.text END,
      CASE WHEN b.cut THEN list_concat(CASE WHEN p.cur <> '' THEN list_append(p.done, {strip('p.cur')}) ELSE p.done END, b.w)
           WHEN p.cur = '' OR length(p.cur) + 2 + length(b.text) <= 500 THEN p.done ELSE list_append(p.done, {strip('p.cur')}) END
      FROM packing p JOIN sized_blocks b ON b.doc_uid = p.doc_uid AND b.section_no = p.section_no AND b.block_no = p.block_no + 1""",
)
part(
    "packed",
    f"""SELECT doc_uid, section_no, unnest(parts) AS content, generate_subscripts(parts, 1) AS part_no FROM (
    SELECT doc_uid, section_no, CASE WHEN cur <> '' THEN list_append(done, {strip('cur')}) ELSE done END AS parts FROM packing WHERE block_no = n)""",
)
oracle("pack_chunks", "SELECT doc_uid, section_no::BIGINT AS section_no, part_no, content FROM packed")
CHUNK_TYPE = f"""(CASE WHEN starts_with(fl, '```') OR starts_with(fl, '~~~') THEN 'code' WHEN starts_with(fl, '|') AND ends_with(fl, '|') THEN 'table'
    WHEN starts_with(fl, '>') THEN 'blockquote' WHEN regexp_matches(fl, '^[-*+] ') OR regexp_matches(fl, '^[0-9]+\\. ') THEN 'list' ELSE 'paragraph' END)"""
FIRST_LINE = f"list_filter(list_transform({line_list('content')}, lambda x: {strip('x')}), lambda x: x <> '')[1]"
part(
    "chunks",
    f"""SELECT *, sha256(doc_uid || ':c:' || chunk_index) AS chunk_id, 'section-' || section_no || ':chunk-' || chunk_index AS source_span,
    {CHUNK_TYPE} AS chunk_type, sha256(content) AS content_hash, length(content) AS token_count FROM (
    SELECT p.doc_uid, s.knowledge_base_id, s.section_id, p.section_no, s.section_title, p.content, s.heading_path, s.source_start_line, s.source_end_line, s.source_anchor,
      row_number() OVER (PARTITION BY p.doc_uid ORDER BY p.section_no, p.part_no) - 1 AS chunk_index,
      {FIRST_LINE.replace('content', 'p.content')} AS fl FROM packed p JOIN sections s ON s.doc_uid = p.doc_uid AND s.section_no = p.section_no)""",
)
oracle(
    "build_chunks",
    """SELECT chunk_id, doc_uid, knowledge_base_id, section_id, section_no::BIGINT AS section_no, section_title, chunk_index, content, source_span, heading_path,
    source_start_line::BIGINT AS source_start_line, source_end_line::BIGINT AS source_end_line, source_anchor, chunk_type, content_hash, token_count FROM chunks""",
)
oracle("detect_chunk_type", "SELECT chunk_id, chunk_type FROM chunks")
oracle(
    "clean_markdown",
    f"""WITH noisy AS (SELECT doc_uid, string_agg(CASE WHEN j % 9 = 3 THEN '---' || chr(10) || l WHEN j % 9 = 5 THEN l || '  ' || chr(10) || chr(10) || ' ' || chr(10)
      WHEN j % 9 = 7 THEN '![a](b)' || chr(10) || l ELSE l END, chr(10) ORDER BY j) AS content FROM (
      SELECT doc_uid, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS j FROM docs) GROUP BY doc_uid),
    kept AS (SELECT doc_uid, i, rtrim(line, {WS}) AS line FROM (SELECT doc_uid, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
      SELECT doc_uid, {line_list('content')} AS l FROM noisy)) WHERE NOT regexp_full_match({strip('line')}, '!\\[[^\\]]*\\]\\([^)]+\\)')
      AND {strip('line')} NOT IN ('目 录', '目录', 'TABLE OF CONTENTS', 'Table of Contents') AND NOT regexp_full_match({strip('line')}, '[-—_]{{3,}}')),
    flagged AS (SELECT *, lag(line) OVER (PARTITION BY doc_uid ORDER BY i) AS before FROM kept)
    SELECT doc_uid, {strip("string_agg(line, chr(10) ORDER BY i)")} || chr(10) AS cleaned FROM flagged WHERE line <> '' OR (before IS NOT NULL AND before <> '') GROUP BY doc_uid""",
)
REF_LISTS = " , ".join(f"regexp_extract_all(content, {lit(p)}, 1)" for p in vi.REFERENCES)
COMPACT = lambda x: f"regexp_replace({x}, {lit(chr(91) + chr(92) + 's' + chr(28) + chr(29) + chr(30) + chr(31) + chr(0x85) + chr(0xa0) + chr(0x3000) + '，。！？、,.?？：:；;（）()《》“”' + chr(34) + chr(39) + '`]+')}, '', 'g')"
part(
    "cross_refs",
    f"""SELECT doc_uid, section_no, row_number() OVER (PARTITION BY doc_uid, section_no ORDER BY o) AS ref_no, target FROM (
    SELECT doc_uid, section_no, target, min(o) AS o FROM (
      SELECT doc_uid, section_no, o, trim({squeeze(f"regexp_replace({strip('t')}, {lit(vi.REFERENCE_SPACING)}, '{chr(92)}1 {chr(92)}2')")}, ' ：:，。；;、') AS target FROM (
        SELECT doc_uid, section_no, unnest(ts) AS t, generate_subscripts(ts, 1) AS o FROM (
          SELECT doc_uid, section_no, flatten([{REF_LISTS}]) AS ts FROM sections)))
    WHERE target <> '' GROUP BY doc_uid, section_no, target)""",
)
oracle("extract_cross_references", "SELECT doc_uid, section_no::BIGINT AS section_no, ref_no, target FROM cross_refs")
part(
    "xref_edges",
    f"""SELECT DISTINCT r.doc_uid, r.section_no AS from_section, s.section_no AS to_section FROM cross_refs r JOIN sections s ON s.doc_uid = r.doc_uid
    AND {COMPACT('r.target')} <> '' AND contains({COMPACT('s.section_title')}, {COMPACT('r.target')})""",
)
oracle("link_cross_references", "SELECT doc_uid, from_section::BIGINT AS from_section, to_section::BIGINT AS to_section FROM xref_edges")
part(
    "hops",
    """RECURSIVE SELECT doc_uid, section_no::BIGINT AS section_no, 0::BIGINT AS hop FROM sections WHERE section_no = 1
    UNION SELECT e.doc_uid, e.to_section::BIGINT, h.hop + 1 FROM hops h JOIN xref_edges e ON e.doc_uid = h.doc_uid AND e.from_section = h.section_no WHERE h.hop < 3""",
)
oracle("expand_reference_hops", "SELECT doc_uid, section_no, min(hop) AS hop FROM hops GROUP BY doc_uid, section_no")
