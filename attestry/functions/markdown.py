"""Markdown structure inside one record: lines, sections, blocks, chunks.

A document is one row and its structure is worked out from arrays in that row, so going
from text to sections and chunks is a narrow transformation: no shuffle, no window, no
Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.text import bind, lines_of, lstrip_chars, non_empty, scan, strip

# Limits of the length-based split.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 100

PATH_SEPARATOR = " > "
SECTION_TYPE = (
    "struct<section_no:int,parent_no:int,section_title:string,section_level:int,heading_path:string,"
    "source_start_line:int,source_end_line:int,content:string>"
)
_STACK_TYPE = "struct<stack:array<struct<level:int,title:string,no:int>>,n:int>"


def is_fence(line: Column) -> Column:
    return F.startswith(line, F.lit("```")) | F.startswith(line, F.lit("~~~"))


def is_ordered_item(line: Column) -> Column:
    """Digits, a dot and a blank before any other ``. ``."""
    return line.rlike(r"^[0-9]+\. ")


def is_bullet(line: Column) -> Column:
    return line.rlike(r"^[-*+] ")


def line_kind(line: Column) -> Column:
    """Kind of a stripped line outside a fence."""
    return (
        F.when(line == "", "blank")
        .when(is_fence(line), "fenced_code")
        .when(F.startswith(line, F.lit(">")), "blockquote")
        .when(F.startswith(line, F.lit("|")) & F.endswith(line, F.lit("|")), "table")
        .when(is_bullet(line) | is_ordered_item(line), "list")
        .otherwise("paragraph")
    )


def heading_level(line: Column) -> Column:
    return F.length(line) - F.length(lstrip_chars(line, "#"))


def heading_title(line: Column) -> Column:
    return strip(lstrip_chars(line, "#"))


def first_heading_title(text: Column, fallback: Column) -> Column:
    """Title of the first ``#`` line, else the fallback."""
    heads = F.filter(F.transform(lines_of(text), strip), lambda s: F.startswith(s, F.lit("#")))
    return F.coalesce(F.nullif(heading_title(F.get(heads, F.lit(0))), F.lit("")), fallback)


def sections_of(text: Column, title: Column) -> Column:
    """Array of sections of a Markdown text, with heading path, parent and line range."""

    def from_lines(lines: Column) -> Column:
        stripped = F.transform(lines, lambda l, i: F.struct((i + 1).alias("line_no"), strip(l).alias("s")))
        found = F.filter(stripped, lambda h: F.startswith(h["s"], F.lit("#")))
        heads = F.transform(
            found,
            lambda h: F.struct(
                h["line_no"].alias("line_no"),
                heading_level(h["s"]).alias("level"),
                F.coalesce(F.nullif(heading_title(h["s"]), F.lit("")), title).alias("title"),
            ),
        )
        root = F.struct(F.lit(0).alias("line_no"), F.lit(1).alias("level"), title.alias("title"))
        return bind(F.concat(F.array(root), heads), lambda entries: _segments(lines, entries))

    return bind(lines_of(text), from_lines)


def _segments(lines: Column, entries: Column) -> Column:
    """One candidate per heading (and the text before the first), then the kept ones."""

    def segment(e: Column, i: Column) -> Column:
        last = F.coalesce(F.get(entries, i + 1)["line_no"] - 1, F.size(lines))
        body = last - e["line_no"]
        start = F.greatest(e["line_no"], F.lit(1))
        return F.struct(
            e["level"].alias("level"),
            e["title"].alias("title"),
            start.alias("start"),
            F.greatest(start, last, F.lit(1)).alias("end"),
            strip(F.array_join(F.slice(lines, e["line_no"] + 1, F.greatest(body, F.lit(0))), "\n")).alias("content"),
            ((body > 0) | (i == F.size(entries) - 1)).alias("can_open"),
        )

    def keep(segs: Column) -> Column:
        # The first section may be blank; later ones need text.
        first = F.array_position(F.transform(segs, lambda s: s["can_open"]), True) - 1
        return bind(
            first,
            lambda f: F.transform(
                segs,
                lambda s, i: s.withField("kept", (i == f) | ((i > f) & (s["content"] != ""))),
            ),
        )

    def step(st: Column, s: Column):
        no = F.when(s["kept"], st["n"] + 1).otherwise(F.lit(0))
        above = F.filter(st["stack"], lambda e: e["level"] < s["level"])
        me = F.struct(s["level"].cast("int").alias("level"), s["title"].alias("title"), no.alias("no"))
        stack = F.concat(above, F.array(me))
        path = F.array_join(non_empty(F.transform(stack, lambda e: e["title"])), PATH_SEPARATOR)
        parent = F.element_at(F.concat(F.array(F.lit(0)), F.filter(F.transform(above, lambda e: e["no"]), lambda n: n > 0)), -1)
        row = F.struct(
            no.alias("section_no"),
            F.nullif(parent, F.lit(0)).alias("parent_no"),
            s["title"].alias("section_title"),
            s["level"].alias("section_level"),
            path.alias("heading_path"),
            s["start"].alias("source_start_line"),
            s["end"].alias("source_end_line"),
            F.when(s["content"] == "", s["title"]).otherwise(s["content"]).alias("content"),
        )
        out = F.filter(F.array(row.cast(SECTION_TYPE)), lambda r: r["section_no"] > 0)
        return F.struct(stack.alias("stack"), F.greatest(st["n"], no).alias("n")), out

    start = F.struct(F.array().cast("array<struct<level:int,title:string,no:int>>").alias("stack"), F.lit(0).alias("n"))
    kept = bind(F.transform(entries, segment), keep)
    return scan(kept, start, _STACK_TYPE, SECTION_TYPE, step)


def fence_flags(lines: Column) -> Column:
    """For each line, whether it lies inside a fence opened by an earlier line."""
    return scan(
        lines,
        F.lit(False),
        "boolean",
        "boolean",
        lambda st, l: (F.when(is_fence(strip(l)), ~st).otherwise(st), F.array(st)),
    )


def blocks_of(text: Column) -> Column:
    """Blocks of a section as ``array<struct<kind, text>>``; a fence stays whole."""

    def from_lines(lines: Column) -> Column:
        marked = F.transform(
            F.arrays_zip(lines.alias("line"), fence_flags(lines).alias("inside")),
            lambda z: bind(
                strip(z["line"]),
                lambda s: F.struct(
                    z["line"].alias("line"),
                    z["inside"].alias("inside"),
                    is_fence(s).alias("fence"),
                    F.when(z["inside"], "fenced_code").otherwise(line_kind(s)).alias("kind"),
                ),
            ),
        )
        return bind(marked, _group_lines)

    return bind(lines_of(text), from_lines)


def _group_lines(marked: Column) -> Column:
    def opens(m: Column, i: Column) -> Column:
        prev = F.get(marked, i - 1)
        closed = prev["fence"] & prev["inside"]
        return (i == 0) | (~m["inside"] & ((prev["kind"] != m["kind"]) | closed))

    starts = F.filter(
        F.transform(marked, lambda m, i: F.when(opens(m, i), i + 1)),
        lambda p: p.isNotNull(),
    )

    def cut(starts: Column) -> Column:
        return F.transform(
            starts,
            lambda p, k: bind(
                F.slice(marked, p, F.coalesce(F.get(starts, k + 1), F.size(marked) + 1) - p),
                lambda part: F.struct(
                    F.get(part, F.lit(0))["kind"].alias("kind"),
                    strip(F.array_join(F.transform(part, lambda m: m["line"]), "\n")).alias("text"),
                ),
            ),
        )

    return F.filter(bind(starts, cut), lambda b: (b["kind"] != "blank") & (b["text"] != ""))


def is_splittable(block: Column, size: int) -> Column:
    """Only an overlong plain paragraph may be cut by length."""
    first = strip(F.get(lines_of(block), F.lit(0)))
    structural = first.rlike(r"^(>|\||```|~~~|[-*+] )") | is_ordered_item(first)
    return (F.length(block) > size) & ~structural


def windows_of(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, group: int = 128) -> Column:
    """Overlapping windows of a text, stripped, empties dropped.

    Cut in two levels (``group`` windows at a time) so that taking a piece of a very long
    text does not walk the whole text once per window.
    """
    if size <= 0:
        return non_empty(F.array(strip(text)))
    step = size - max(0, min(overlap, size - 1))

    def from_text(t: Column) -> Column:
        count = F.ceil(F.greatest(F.length(t) - size, F.lit(0)) / step).cast("int") + 1
        outer = F.sequence(F.lit(0), ((count - 1) / group).cast("int"))
        return F.flatten(
            F.transform(
                outer,
                lambda o: bind(
                    F.substring(t, o * (group * step) + 1, F.lit(group * step + size)),
                    lambda part: F.transform(
                        F.sequence(F.lit(0), F.least(F.lit(group), count - o * group) - 1),
                        lambda j: strip(F.substring(part, j * step + 1, F.lit(size))),
                    ),
                ),
            )
        )

    return non_empty(bind(text, from_text))


def pack_blocks(blocks: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Greedy join of block texts up to ``size``; overlong paragraphs become windows."""
    none = F.array().cast("array<string>")

    def step(cur: Column, block: Column):
        has = cur != ""
        flush = F.when(has, F.array(strip(cur))).otherwise(none)
        fits = ~has | (F.length(cur) + 2 + F.length(block) <= size)
        joined = F.when(has, F.concat(cur, F.lit("\n\n"), block)).otherwise(block)
        split = is_splittable(block, size) if size > 0 else F.lit(False)
        state = F.when(split, F.lit("")).when(fits, joined).otherwise(block)
        out = F.when(split, F.concat(flush, windows_of(block, size, overlap))).when(fits, none).otherwise(flush)
        return state, out

    return non_empty(
        scan(blocks, F.lit(""), "string", "string", step, finish=lambda cur: non_empty(F.array(strip(cur))))
    )


def chunks_of(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunk texts of one section."""
    return pack_blocks(F.transform(blocks_of(text), lambda b: b["text"]), size, overlap)


def chunk_type(text: Column) -> Column:
    """Type from the first non-blank line."""
    first = F.get(F.filter(F.transform(lines_of(text), strip), lambda s: s != ""), F.lit(0))
    return bind(
        F.coalesce(first, F.lit("")),
        lambda s: F.when(is_fence(s), "code")
        .when(F.startswith(s, F.lit("|")) & F.endswith(s, F.lit("|")), "table")
        .when(F.startswith(s, F.lit(">")), "blockquote")
        .when(is_bullet(s) | is_ordered_item(s), "list")
        .otherwise("paragraph"),
    )
