"""Registered queries: document structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import structure as st
from verification import inputs as vi
from verification.inputs import Inputs
from verification.registry import register


@register("explode_lines")
def explode_lines(i: Inputs):
    return st.explode_lines(i.docs)


@register("parse_sections")
def parse_sections(i: Inputs):
    return st.parse_sections(i.docs).drop("parent_no")


@register("heading_path")
def heading_path(i: Inputs):
    return st.heading_path(st.parse_sections(i.docs))


@register("section_tree")
def section_tree(i: Inputs):
    return st.section_tree(st.parse_sections(i.docs))


@register("classify_lines")
def classify_lines(i: Inputs):
    return st.classify_lines(st.explode_lines(i.docs)).select("doc_uid", "line_no", "kind")


@register("fence_state")
def fence_state(i: Inputs):
    """Lines with ``- `` items turned into fence marks, so that fences occur."""
    fenced = i.docs.withColumn("content", F.replace("content", F.lit("\n- "), F.lit("\n```\n")))
    return st.fence_state(fenced).select("doc_uid", "line_no", "in_fence", "kind")


@register("split_blocks")
def split_blocks(i: Inputs):
    return st.split_blocks(st.parse_sections(i.docs)).drop("section_id")


@register("split_by_length")
def split_by_length(i: Inputs):
    return st.split_by_length(st.split_blocks(st.parse_sections(i.docs)), 120, 30).drop("section_id")


@register("pack_chunks")
def pack_chunks(i: Inputs):
    return st.pack_chunks(st.parse_sections(i.docs))


@register("build_chunks")
def build_chunks(i: Inputs):
    return st.build_chunks(i.docs).drop("updated_at", "doc_title")


@register("detect_chunk_type")
def detect_chunk_type(i: Inputs):
    return st.detect_chunk_type(i.lazy.chunks)


@register("clean_markdown")
def clean_markdown(i: Inputs):
    """Documents with rules, image lines and blank runs put in at fixed line numbers."""
    noisy = F.expr(
        "array_join(transform(split(content, '\n'), (l, j) -> CASE WHEN j % 9 = 3 THEN concat('---\n', l)"
        " WHEN j % 9 = 5 THEN concat(l, '  \n\n \n') WHEN j % 9 = 7 THEN concat('![a](b)\n', l) ELSE l END), '\n')"
    )
    return st.clean_markdown(i.docs.withColumn("content", noisy))


def references(i: Inputs):
    return st.extract_cross_references(i.corpus.sections, vi.REFERENCES, vi.REFERENCE_SPACING)


@register("extract_cross_references")
def extract_cross_references(i: Inputs):
    return references(i)


@register("link_cross_references")
def link_cross_references(i: Inputs):
    return st.link_cross_references(references(i), i.corpus.sections)


@register("expand_reference_hops")
def expand_reference_hops(i: Inputs):
    """From the first section of every document."""
    edges = st.link_cross_references(references(i), i.corpus.sections)
    seeds = i.corpus.sections.where("section_no = 1").select("doc_uid", "section_no")
    return st.expand_reference_hops(seeds, edges)
