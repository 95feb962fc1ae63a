"""Registered queries: retrieval and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import normalize as nz
from attestry.operators import retrieval as rt
from attestry.operators import vectors as vc
from attestry.plans import search
from verification import inputs as vi
from verification.inputs import Inputs
from verification.registry import register


@register("build_postings")
def build_postings(i: Inputs):
    return rt.build_postings(i.corpus.chunks, vi.DICTIONARY)


def variants(i: Inputs):
    return nz.expand_queries(i.queries, vi.DICTIONARY, 6)


@register("fulltext_match")
def fulltext_match(i: Inputs):
    return rt.fulltext_match(variants(i), i.corpus.word_sets, postings=i.corpus.postings, frequencies=i.corpus.frequencies)


@register("substring_fallback")
def substring_fallback(i: Inputs):
    """Pieces of words as queries: single terms cut short match no index term."""
    pieces = i.queries.where("query_id LIKE 'k%'").select(
        "query_id", F.lit(1).alias("variant_no"), F.regexp_extract("text", "^[^ ]([^ ]+)", 1).alias("text")
    )
    both = variants(i).unionByName(pieces.withColumn("query_id", F.concat(F.lit("p"), "query_id")))
    matched = rt.fulltext_match(both, i.corpus.word_sets, postings=i.corpus.postings, frequencies=i.corpus.frequencies)
    return rt.substring_fallback(both, matched, i.corpus.chunks, i.corpus.chunk_grams).drop("updated_at")


@register("fulltext_search")
def fulltext_search(i: Inputs):
    return search.search_fulltext(i.queries, i.corpus, 10).select("query_id", "rank", "chunk_id", "doc_uid")


@register("embed_hash")
def embed_hash(i: Inputs):
    """Slots as whole numbers: a slot times 17 times the text length is a sum of integers."""
    chunks = i.corpus.chunks.select("chunk_id", F.col("token_count").alias("n"), vc.hash_vector(F.col("content")).alias("embedding"))
    rows = chunks.select("chunk_id", "n", F.posexplode("embedding").alias("slot", "value"))
    return rows.where("value <> 0").select("chunk_id", "slot", F.round(F.col("value") * 17 * F.col("n")).cast("bigint").alias("weight"))


@register("vector_search")
def vector_search(i: Inputs):
    """The queries of the text tests, restricted to their knowledge base."""
    q = i.scoped.select("query_id", "knowledge_base_id", vc.hash_vector(F.col("text")).alias("embedding"))
    return vc.vector_search(q, i.corpus.vectors, 10).select("query_id", "rank", "chunk_id", "doc_uid", "score")


def stored_vectors(i: Inputs):
    return i.table("embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_uid"), "embedding"
    )


def vector_queries(i: Inputs):
    """Every tenth stored vector's neighbours are asked for."""
    return i.table("embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@register("vector_search_stored")
def vector_search_stored(i: Inputs):
    return vc.vector_search(i.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), stored_vectors(i), 5).select(
        "query_id", "rank", "chunk_id", "score"
    )


@register("vector_search_cells")
def vector_search_cells(i: Inputs):
    """The path for query tables too large to send whole; the same exact result."""
    q = i.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return vc.vector_search_cells(q, stored_vectors(i), 5).select("query_id", "rank", "chunk_id", "score")


@register("vector_search_approx")
def vector_search_approx(i: Inputs):
    q = i.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return vc.vector_search_approx(q, stored_vectors(i), 5).select("query_id", "rank", "chunk_id", "score")


@register("vector_search_recall")
def vector_search_recall(i: Inputs):
    """Share of the exact five neighbours, a vector's own match left out, that the approximate search finds."""
    q = i.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    pairs = lambda found: found.where("query_id <> chunk_id").select("query_id", "chunk_id")
    exact, near = pairs(vc.vector_search(q, stored_vectors(i), 6)), pairs(vc.vector_search_approx(q, stored_vectors(i), 6))
    both = exact.join(near.withColumn("found", F.lit(1)), ["query_id", "chunk_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("neighbours"), F.round(F.avg(F.coalesce("found", F.lit(0))), 4).alias("recall"))


@register("attach_metadata")
def attach_metadata(i: Inputs):
    hits = search.search_fulltext(i.queries, i.corpus, 10).select("query_id", "rank", "chunk_id", "doc_uid")
    return rt.attach_metadata(hits, i.corpus.docs.where("ingest_status = 'completed'"))


@register("hybrid_search")
def hybrid_search(i: Inputs):
    return search.search_hybrid(i.queries, i.corpus, 10).drop("rerank_score")


@register("preview_results")
def preview_results(i: Inputs):
    return rt.preview_results(search.search_fulltext(i.queries, i.corpus, 10), i.corpus.chunks, i.queries)


@register("apply_rerank")
def apply_rerank(i: Inputs):
    """Scores for two thirds of the hits, some with an index out of range."""
    hits = search.search_hybrid(i.queries, i.corpus, 10)
    number = F.substring("query_id", 2, 20).cast("int")
    scores = hits.where(F.col("rank") % 3 != 0).select(
        "query_id", (F.col("rank") - F.when(F.col("rank") == 1, 2).otherwise(1)).alias("item_index"), ((number * 31 + F.col("rank") * 17) % 101 / 100.0).alias("relevance_score")
    )
    return rt.apply_rerank(hits, scores, 5).select("query_id", "rank", "chunk_id", "rerank_score")


@register("expand_context")
def expand_context(i: Inputs):
    hits = search.search_fulltext(i.queries, i.corpus, 10).select("query_id", "rank", "chunk_id", "doc_uid")
    odd = hits.withColumn("neighbor_window", F.col("rank") % 3).withColumn("include_section_context", F.col("rank") % 2 == 0)
    return rt.expand_context(odd, i.corpus.chunks, i.corpus.sections, section_max_chars=300).select(
        "query_id", "chunk_id", "section_title", "context_mode", "expanded_content"
    )


@register("chunk_detail")
def chunk_detail(i: Inputs):
    return rt.chunk_detail(i.corpus.chunks, i.corpus.docs, i.corpus.sections).select(
        "chunk_id", "doc_uid", "knowledge_base_id", "doc_title", "author", "source_name", "section_title", "chunk_index", "content"
    )


def section_questions(i: Inputs):
    q = F.col("question")
    terms = nz.question_terms(q, vi.QUESTION)
    return i.questions.withColumn("terms", terms).withColumn("section_terms", nz.tree_terms(F.col("terms"), vi.QUESTION))


@register("score_sections")
def score_sections(i: Inputs):
    """Questions against all sections of their knowledge base, best 30 per document."""
    q = section_questions(i).select("question_id", "knowledge_base_id", F.col("section_terms").alias("terms"))
    return rt.score_sections(q, i.corpus.sections, lexicon=vi.QUESTION, grams=i.corpus.section_grams).select("question_id", "doc_uid", "section_no", "score", "rank")


def stored_index(i: Inputs) -> dict:
    return {"word_sets": i.corpus.word_sets, "section_index": i.corpus.section_grams, "chunk_index": i.corpus.chunk_grams}


def per_document(i: Inputs):
    docs = i.corpus.docs.where("ingest_status = 'completed'").select("doc_uid", "knowledge_base_id")
    return i.questions.join(docs, "knowledge_base_id").drop("knowledge_base_id")


@register("supplement_chunks")
def supplement_chunks(i: Inputs):
    q = F.col("question")
    planned = per_document(i).withColumn("terms", nz.question_terms(q, vi.QUESTION)).withColumn(
        "chunk_terms", nz.chunk_terms(F.col("terms"), q, vi.QUESTION, vi.DICTIONARY)
    )
    return rt.supplement_chunks(planned, i.corpus.chunks, lexicon=vi.QUESTION, dictionary=vi.DICTIONARY, word_sets=i.corpus.word_sets, grams=i.corpus.chunk_grams).select(
        "question_id", "doc_uid", "rank", "chunk_id", "term"
    )


@register("rank_sections_local")
def rank_sections_local(i: Inputs):
    found = rt.rank_sections_local(per_document(i), i.corpus.sections, i.corpus.chunks, lexicon=vi.QUESTION, dictionary=vi.DICTIONARY, **stored_index(i))
    return found.select("question_id", "doc_uid", "source_type", "evidence_key", "part", "rank")


def kb_evidence(i: Inputs):
    return rt.collect_kb_evidence(i.questions, i.corpus.docs, i.corpus.sections, i.corpus.chunks, lexicon=vi.QUESTION, dictionary=vi.DICTIONARY, **stored_index(i))


@register("collect_kb_evidence")
def collect_kb_evidence(i: Inputs):
    return kb_evidence(i).select("question_id", "position_no", "doc_uid", "title", "position", "chunk_id")


@register("merge_evidence")
def merge_evidence(i: Inputs):
    """Sections found by two overlapping question tables, the later ones supplementary."""
    q = section_questions(i).select("question_id", "knowledge_base_id", F.col("section_terms").alias("terms"))
    scored = rt.score_sections(q, i.corpus.sections, lexicon=vi.QUESTION, grams=i.corpus.section_grams)
    first = rt.section_evidence(scored.where("rank <= 2"), i.corpus.sections)
    again = rt.section_evidence(scored.where("rank >= 2"), i.corpus.sections).withColumn("part", F.lit(2))
    return rt.merge_evidence(first, again).select("question_id", "doc_uid", "evidence_key", "part", "rank")


@register("available_documents")
def available_documents(i: Inputs):
    return rt.available_documents(i.corpus.docs)


@register("query_history")
def query_history(i: Inputs):
    """Events as stored questions with a JSON debug text."""
    e = i.events
    kind = F.when(F.col("event_id") % 3 == 0, '{"question_plan":{"question_type":"summary"}}').when(F.col("event_id") % 3 == 1, "{}").otherwise("broken")
    evidence = F.when(F.col("event_id") % 4 == 0, F.lit("[")).otherwise(
        F.concat(F.lit('[{"doc_uid":"u'), F.col("user_id").cast("string"), F.lit('","title":"t"},{"doc_uid":"x"}]'))
    )
    stored = e.select(
        F.col("event_id").alias("query_id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("knowledge_base_id"),
        F.col("event_type").alias("question"), F.col("props").alias("answer"), evidence.alias("evidence_json"), kind.alias("debug_json"),
        F.col("ts").alias("created_at"),
    )
    return rt.query_history(stored, 20)


@register("rebuild_vectors")
def rebuild_vectors(i: Inputs):
    return vc.rebuild_vectors(i.corpus.chunks)


@register("check_vector_dimension")
def check_vector_dimension(i: Inputs):
    """A third of the stored vectors is cut to half length first."""
    stored = i.corpus.vectors.select(
        "chunk_id", F.when(F.conv(F.substring("chunk_id", 1, 4), 16, 10).cast("int") % 3 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding")
    )
    checked = vc.check_vector_dimension(stored, i.corpus.chunks.select("chunk_id", "content"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    lengths = i.corpus.chunks.select("chunk_id", "token_count")
    weight = F.round(total * 17 * F.col("token_count")).cast("bigint")
    return checked.join(lengths, "chunk_id").select("chunk_id", "recomputed", F.size("embedding").alias("dimension"), weight.alias("weight"))


@register("index_consistency")
def index_consistency(i: Inputs):
    """Index rows of every ninth document missing, vectors of every tenth."""
    n = F.substring("doc_uid", 2, 9).cast("int")
    return vc.index_consistency(i.corpus.chunks, i.corpus.word_sets.where(n % 9 != 0), i.corpus.vectors.where(n % 10 != 0))
