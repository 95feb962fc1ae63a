"""Document structure: lines, sections, blocks, chunks and cross references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import lexicons as lx
from attestry.functions import markdown as md
from attestry.functions import text as tx
from attestry.functions.session import cut_lineage
from attestry.operators.matching import contains_join


def explode_lines(docs: DataFrame) -> DataFrame:
    """(doc_uid, line_no, line), line_no from 1."""
    return docs.select("doc_uid", F.posexplode(tx.lines_of("content")).alias("p", "line")).select(
        "doc_uid", (F.col("p") + 1).alias("line_no"), "line"
    )


def section_id(doc_uid: Column, section_no: Column) -> Column:
    return F.sha2(F.concat_ws(":", doc_uid, F.lit("s"), section_no.cast("string")), 256)


def chunk_id(doc_uid: Column, chunk_index: Column) -> Column:
    return F.sha2(F.concat_ws(":", doc_uid, F.lit("c"), chunk_index.cast("string")), 256)


def parse_sections(docs: DataFrame) -> DataFrame:
    """One row per section; a narrow transformation of the documents."""
    # The outer form keeps the optimizer from copying the parse into a size filter.
    rows = docs.select(
        "doc_uid", "knowledge_base_id", F.explode_outer(md.sections_of(F.col("content"), F.col("doc_title"))).alias("s")
    ).where("s IS NOT NULL")
    no = F.col("s.section_no")
    return rows.select(
        "doc_uid",
        "knowledge_base_id",
        no.alias("section_no"),
        section_id(F.col("doc_uid"), no).alias("section_id"),
        F.when(F.col("s.parent_no").isNotNull(), section_id(F.col("doc_uid"), F.col("s.parent_no"))).alias("parent_section_id"),
        "s.parent_no",
        "s.section_title",
        "s.section_level",
        "s.heading_path",
        "s.source_start_line",
        "s.source_end_line",
        _anchor("s.source_start_line", "s.source_end_line").alias("source_anchor"),
        F.concat(F.lit("section-"), no.cast("string")).alias("source_span"),
        "s.content",
    )


def _anchor(start: str, end: str) -> Column:
    return F.concat(F.lit("L"), F.col(start).cast("string"), F.lit("-L"), F.col(end).cast("string"))


def heading_path(sections: DataFrame) -> DataFrame:
    return sections.select("doc_uid", "section_no", "section_level", "heading_path")


def section_tree(sections: DataFrame) -> DataFrame:
    """Parent and depth of each section; order by section_no is depth first."""
    return sections.select(
        "doc_uid",
        "section_no",
        "parent_no",
        "section_title",
        F.size(F.split("heading_path", md.PATH_SEPARATOR)).alias("depth"),
        F.row_number().over(Window.partitionBy("doc_uid").orderBy("source_start_line")).alias("preorder"),
    )


def classify_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("kind", md.line_kind(tx.strip("line")))


def fence_state(docs: DataFrame) -> DataFrame:
    """Each line with whether it lies in a fence and the kind that follows from it."""
    zipped = tx.bind(
        tx.lines_of("content"),
        lambda ls: F.arrays_zip(ls.alias("line"), md.fence_flags(ls).alias("in_fence")),
    )
    rows = docs.select("doc_uid", F.posexplode(zipped).alias("p", "z"))
    return rows.select(
        "doc_uid",
        (F.col("p") + 1).alias("line_no"),
        F.col("z.line").alias("line"),
        F.col("z.in_fence").alias("in_fence"),
        F.when(F.col("z.in_fence"), "fenced_code").otherwise(md.line_kind(tx.strip("z.line"))).alias("kind"),
    )


def split_blocks(sections: DataFrame) -> DataFrame:
    rows = sections.select("doc_uid", "section_no", "section_id", F.posexplode(md.blocks_of(F.col("content"))).alias("p", "b"))
    return rows.select("doc_uid", "section_no", "section_id", (F.col("p") + 1).alias("block_no"), "b.kind", "b.text")


def split_by_length(blocks: DataFrame, size: int = md.CHUNK_SIZE, overlap: int = md.CHUNK_OVERLAP) -> DataFrame:
    """Windows of the overlong paragraph blocks."""
    long_blocks = blocks.where(md.is_splittable(F.col("text"), size))
    rows = long_blocks.select(
        "doc_uid", "section_no", "section_id", "block_no", F.posexplode(md.windows_of(F.col("text"), size, overlap)).alias("p", "window_text")
    )
    return rows.select("doc_uid", "section_no", "section_id", "block_no", (F.col("p") + 1).alias("window_no"), "window_text")


def pack_chunks(sections: DataFrame, size: int = md.CHUNK_SIZE, overlap: int = md.CHUNK_OVERLAP) -> DataFrame:
    """Chunk texts of each section, numbered inside the section."""
    rows = sections.select("doc_uid", "section_no", F.posexplode(md.chunks_of(F.col("content"), size, overlap)).alias("p", "content"))
    return rows.select("doc_uid", "section_no", (F.col("p") + 1).alias("part_no"), "content")


def build_chunks(docs: DataFrame, size: int = md.CHUNK_SIZE, overlap: int = md.CHUNK_OVERLAP) -> DataFrame:
    """Documents to chunks in one narrow step.

    The chunk index counts through the whole document; as all chunks of a document come
    from one row it is the array position, not a window.
    """
    per_section = F.transform(
        md.sections_of(F.col("content"), F.col("doc_title")),
        lambda s: F.transform(
            md.chunks_of(s["content"], size, overlap),
            lambda c: F.struct(
                s["section_no"].alias("section_no"),
                s["section_title"].alias("section_title"),
                s["heading_path"].alias("heading_path"),
                s["source_start_line"].alias("source_start_line"),
                s["source_end_line"].alias("source_end_line"),
                c.alias("content"),
            ),
        ),
    )
    rows = docs.select(
        "doc_uid", "knowledge_base_id", "doc_title", "updated_at", F.posexplode_outer(F.flatten(per_section)).alias("chunk_index", "c")
    ).where("chunk_index IS NOT NULL")
    text = F.col("c.content")
    return rows.select(
        chunk_id(F.col("doc_uid"), F.col("chunk_index")).alias("chunk_id"),
        "doc_uid",
        "knowledge_base_id",
        section_id(F.col("doc_uid"), F.col("c.section_no")).alias("section_id"),
        F.col("c.section_no").alias("section_no"),
        F.col("c.section_title").alias("section_title"),
        "doc_title",
        "chunk_index",
        text.alias("content"),
        F.concat(
            F.lit("section-"), F.col("c.section_no").cast("string"), F.lit(":chunk-"), F.col("chunk_index").cast("string")
        ).alias("source_span"),
        F.col("c.heading_path").alias("heading_path"),
        F.col("c.source_start_line").alias("source_start_line"),
        F.col("c.source_end_line").alias("source_end_line"),
        _anchor("c.source_start_line", "c.source_end_line").alias("source_anchor"),
        md.chunk_type(text).alias("chunk_type"),
        F.sha2(text, 256).alias("content_hash"),
        F.length(text).alias("token_count"),
        "updated_at",
    )


def detect_chunk_type(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", md.chunk_type(F.col("content")).alias("chunk_type"))


def clean_markdown(docs: DataFrame) -> DataFrame:
    """Without image lines, contents titles and rules; blank runs squeezed to one."""
    noise = lambda s: (
        s.rlike(r"^!\[[^\]]*\]\([^)]+\)$") | s.isin(*lx.NOISE_TITLES) | s.rlike(r"^[-—_]{3,}$")
    )
    kept = F.transform(F.filter(tx.lines_of("content"), lambda l: ~noise(tx.strip(l))), tx.rstrip)
    squeezed = tx.bind(kept, lambda k: F.filter(k, lambda l, i: (l != "") | ((i > 0) & (F.get(k, i - 1) != ""))))
    return docs.select("doc_uid", F.concat(tx.strip(F.array_join(squeezed, "\n")), F.lit("\n")).alias("cleaned"))


def extract_cross_references(
    sections: DataFrame,
    patterns: Sequence[str] = lx.REFERENCE_PATTERNS,
    spacing: str = lx.REFERENCE_SPACING,
) -> DataFrame:
    """(doc_uid, section_no, ref_no, target): distinct targets in pattern, then text order."""
    found = F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns]))
    tidy = lambda t: F.trim(tx.squeeze(F.regexp_replace(tx.strip(t), spacing, "$1 $2")), F.lit(lx.REFERENCE_EDGES))
    targets = F.array_distinct(tx.non_empty(F.transform(found, tidy)))
    rows = sections.select("doc_uid", "section_no", F.posexplode(targets).alias("p", "target"))
    return rows.select("doc_uid", "section_no", (F.col("p") + 1).alias("ref_no"), "target")


PUNCTUATION = "[\\s\\x1c-\\x1f\\x85\\xa0\\u3000，。！？、,.?？：:；;（）()《》“”\"'`]+"


def compact(text: Column) -> Column:
    """Text without white space and punctuation."""
    return F.regexp_replace(text, PUNCTUATION, "")


def link_cross_references(references: DataFrame, sections: DataFrame) -> DataFrame:
    """Edges from a section to the sections of its document whose title contains a target.

    The containment join runs on (document, rarest n-gram of the target), so a document
    with many sections is not paired with itself.
    """
    needles = (
        references.select("doc_uid", "section_no", compact(F.col("target")).alias("needle"))
        .where("needle <> ''")
        .groupBy("doc_uid", "needle")
        .agg(F.collect_set("section_no").alias("from_sections"))
        .withColumn("needle_id", F.sha2(F.concat_ws("\u0001", "doc_uid", "needle"), 256))
    )
    titles = sections.select("doc_uid", F.col("section_no").alias("to_section"), compact(F.col("section_title")).alias("hay"))
    hits = contains_join(needles, titles, needle="needle", hay="hay", needle_key="needle_id", hay_keys=["doc_uid", "to_section"], on=["doc_uid"])
    return (
        hits.join(needles.select("needle_id", "from_sections"), "needle_id")
        .select("doc_uid", F.explode("from_sections").alias("from_section"), "to_section")
        .distinct()
    )


def expand_reference_hops(seeds: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Sections reached from the seeds by following references, with the first hop count.

    ``seeds`` has (doc_uid, section_no).  A section is never visited twice; each round is
    written to the checkpoint folder, so a lost executor does not replay earlier rounds.
    """
    edges = cut_lineage(edges)
    visited = seeds.select("doc_uid", "section_no").distinct().withColumn("hop", F.lit(0))
    frontier = visited
    for hop in range(1, rounds + 1):
        at = frontier.select("doc_uid", F.col("section_no").alias("from_section"))
        step = at.join(edges, ["doc_uid", "from_section"]).select("doc_uid", F.col("to_section").alias("section_no"))
        frontier = cut_lineage(
            step.distinct().join(visited, ["doc_uid", "section_no"], "left_anti").withColumn("hop", F.lit(hop))
        )
        visited = visited.unionByName(frontier)
    return visited
