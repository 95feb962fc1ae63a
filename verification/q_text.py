"""Registered queries: text normalisation and query building."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import normalize as nz
from verification import inputs as vi
from verification.inputs import Inputs
from verification.registry import register


@register("normalize_terms")
def normalize_terms(i: Inputs):
    return nz.normalize_terms(i.corpus.chunks.select(F.col("chunk_id").alias("query_id"), F.col("content").alias("text")), vi.DICTIONARY)


@register("expand_queries")
def expand_queries(i: Inputs):
    return nz.expand_queries(i.queries, vi.DICTIONARY, 6)


@register("build_index_text")
def build_index_text(i: Inputs):
    return nz.build_index_text(i.corpus.chunks, vi.DICTIONARY)


@register("normalize_search_query")
def normalize_search_query(i: Inputs):
    return nz.normalize_search_query(i.table("documents").select(F.col("doc_id").alias("query_id"), "text"))


@register("tokenize_overlap")
def tokenize_overlap(i: Inputs):
    return nz.tokenize_overlap(i.table("documents"), "doc_id", "text")


@register("highlight_terms")
def highlight_terms(i: Inputs):
    """Every conversation turn highlighted with its own conversation's first-turn words."""
    c = i.table("conversations")
    first = c.where("turn = 0").select("conv_id", F.array_join(F.slice(F.split(nz.search_text(F.col("text")), " "), 1, 3), ";").alias("query"))
    rows = c.join(first, "conv_id")
    return nz.highlight_terms(rows, "text", "query").select("conv_id", "turn", "highlighted")


@register("strip_logic_words")
def strip_logic_words(i: Inputs):
    return nz.strip_logic_words(i.claims, vi.LOGIC)


@register("topic_focus")
def topic_focus(i: Inputs):
    return nz.topic_focus(i.claims, vi.LOGIC)


@register("keyword_focus")
def keyword_focus(i: Inputs):
    """Claims written without blanks, as the operator expects them."""
    joined = i.claims.withColumn("claim_text", F.replace("claim_text", F.lit(" ")))
    return nz.keyword_focus(joined, vi.LOGIC)


@register("counter_probe")
def counter_probe(i: Inputs):
    return nz.counter_probe(i.claims, vi.LOGIC)


@register("build_retrieval_queries")
def build_retrieval_queries(i: Inputs):
    return nz.build_retrieval_queries(i.claims.drop("knowledge_base_id"), vi.LOGIC, vi.DICTIONARY)


@register("extract_question_terms")
def extract_question_terms(i: Inputs):
    """Questions as written and without blanks, so that both paths are taken."""
    q = i.questions.select(F.concat(F.lit("s"), F.col("question_id").cast("string")).alias("question_id"), "question")
    flat = i.questions.select(
        F.concat(F.lit("u"), F.col("question_id").cast("string")).alias("question_id"), F.replace("question", F.lit(" ")).alias("question")
    )
    return nz.extract_question_terms(q.unionByName(flat), vi.QUESTION)


@register("filter_generic_terms")
def filter_generic_terms(i: Inputs):
    return nz.filter_generic_terms(i.questions, vi.QUESTION, vi.DICTIONARY)
