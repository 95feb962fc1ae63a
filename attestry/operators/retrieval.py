"""Batch retrieval: a table of queries against a table of chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.functions.session import BROADCAST_ROWS, cut_lineage, small
from attestry.functions.text import contains_any
from attestry.lexicons import DEFAULT_DICTIONARY, CHECK_POLICY, QuestionLexicon, TermDictionary
from attestry.operators import normalize as nz
from attestry.operators.grams import GramIndex, build_grams, find_needles
from attestry.operators.matching import rarest_keys
from attestry.operators.paging import ranked

HIT_COLUMNS = ["query_id", "rank", "chunk_id", "doc_uid", "score", "rerank_score", "retrieval_source", "matched_sources"]


# ------------------------------------------------------------------------- postings
def _numbers(rows: DataFrame) -> list[str]:
    """The column that numbers stored rows, if they have it."""
    return [c for c in rows.columns if c == "serial"]


def chunk_word_sets(chunks: DataFrame, dictionary: TermDictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """One row per chunk with its distinct index terms, and with the chunk's number where it has one."""
    return chunks.select(
        *_numbers(chunks),
        "chunk_id",
        "doc_uid",
        "knowledge_base_id",
        "chunk_index",
        tx.words_of(nz.index_text(F.col("content"), dictionary)).alias("terms"),
    )


def build_postings(chunks: DataFrame, dictionary: TermDictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """(term, chunk_id, doc_uid, knowledge_base_id)."""
    return postings_of(chunk_word_sets(chunks, dictionary)).drop("chunk_index")


def postings_of(word_sets: DataFrame) -> DataFrame:
    """(term, chunk_id, doc_uid, knowledge_base_id, chunk_index): the index by term; no row holds more than one term."""
    return word_sets.select(F.explode("terms").alias("term"), "chunk_id", "doc_uid", "knowledge_base_id", "chunk_index")


BLOCK = 16  # bits of a chunk's number inside its block
TERMS = 1 << 21  # terms of chunks that are grouped at a time
PRUNE_AT_MOST = 1_000  # distinct terms that a filter names; beyond, the join alone selects
_POSTINGS = "term string, knowledge_base_id string, block long, found int, items array<int>"


def _chunks_of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch["terms"].flatten())
        if size >= TERMS:
            yield _by_term(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        yield _by_term(pa.Table.from_batches(held))


def _by_term(rows: pa.Table) -> pa.RecordBatch:
    terms = rows["terms"].combine_chunks()
    words, bases = terms.flatten().dictionary_encode(), rows["knowledge_base_id"].combine_chunks().dictionary_encode("encode")
    of, serial = pc.list_parent_indices(terms).to_numpy(), rows["serial"].to_numpy()
    word, base, block = words.indices.to_numpy(), bases.indices.to_numpy()[of], (serial >> BLOCK)[of]
    order = np.lexsort((serial[of], block, base, word))
    word, base, block = word[order], base[order], block[order]
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (base[1:] != base[:-1]) | (block[1:] != block[:-1])]))
    offsets = np.concatenate([first, [len(word)]]).astype(np.int32)
    items = pa.ListArray.from_arrays(pa.array(offsets), pa.array((serial[of][order] & ((1 << BLOCK) - 1)).astype(np.int32)))
    columns = [words.dictionary.take(pa.array(word[first])), bases.dictionary.take(pa.array(base[first])), pa.array(block[first]), pa.array(np.diff(offsets)), items]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _POSTINGS.split(", ")])


def block_postings(word_sets: DataFrame) -> DataFrame:
    """The index to store: (term, knowledge_base_id, block, found, items), some chunks of one block and knowledge base
    that have the term, by their numbers.  Every task lays its own chunks out in order of terms, without a shuffle."""
    rows = word_sets.select("serial", "knowledge_base_id", "terms").mapInArrow(_chunks_of_terms, _POSTINGS)
    return rows.sortWithinPartitions("term", "knowledge_base_id", "block")


def block_frequencies(postings: DataFrame) -> DataFrame:
    """(term, found) of stored postings."""
    return postings.groupBy("term").agg(F.sum("found").alias("found"))


def term_frequencies(postings: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(…scope, term, found): the chunks that hold each term."""
    return postings.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("found"))


# -------------------------------------------------------------------- full-text AND
SCOPES = ("doc_uid", "knowledge_base_id")


def _filters_hold(rows: DataFrame) -> Column:
    """A query's own document or knowledge-base filter, where it has one."""
    held = F.lit(True)
    for name in SCOPES:
        if f"f_{name}" in rows.columns:
            held = held & (F.col(f"f_{name}").isNull() | (F.col(f"f_{name}") == F.col(name)))
    return held


def _with_filters(queries: DataFrame, scope: Sequence[str]) -> DataFrame:
    for name in SCOPES:
        if name in queries.columns and name not in scope:
            queries = queries.withColumnRenamed(name, f"f_{name}")
    return queries


def fulltext_match(
    variants: DataFrame,
    word_sets: DataFrame,
    scope: Sequence[str] = (),
    postings: DataFrame | None = None,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """(query_id, variant_no, chunk_id, doc_uid, chunk_index): chunks with every query term.

    ``variants`` is (query_id, variant_no, text, …filters).  Each variant enters the postings through its
    rarest term only, so common terms never form join groups; the term sets are fetched by chunk for the
    candidates that this leaves.  ``postings`` (``block_postings``) and ``frequencies`` are the stored index where
    there is one, over numbered word sets; a knowledge-base filter holds before chunks are fetched.
    ``scope`` names filters every variant has; they become join keys, and the word sets are read instead of the index.
    """
    scope = list(scope)
    stored = postings is not None and frequencies is not None and not scope
    variants = _with_filters(variants, scope)
    filters = [c for c in variants.columns if c.startswith("f_")]
    wanted = variants.select("query_id", "variant_no", *scope, *filters, tx.words_of("text").alias("need")).where(F.size("need") > 0)
    by_term = wanted.select("query_id", "variant_no", *scope, *filters, "need", F.explode("need").alias("term"))
    if stored:
        drivers = cut_lineage(rarest_keys(by_term, frequencies, ["query_id", "variant_no"], scope, "term"))
        return _matched_by_blocks(drivers, word_sets, postings)
    postings = postings_of(word_sets)
    frequencies = term_frequencies(postings.join(small(cut_lineage(by_term.select(*scope, "term").distinct())), [*scope, "term"], "left_semi"), scope)
    drivers = cut_lineage(rarest_keys(by_term, frequencies, ["query_id", "variant_no"], scope, "term"))
    found = postings.join(small(drivers), [*scope, "term"])
    found = found.where(_filters_hold(found)).select("query_id", "variant_no", "need", "chunk_id", "doc_uid", "chunk_index")
    held = found.join(word_sets.select("chunk_id", "terms"), "chunk_id").where(F.size(F.array_except("need", "terms")) == 0)
    return held.select("query_id", "variant_no", "chunk_id", "doc_uid", "chunk_index")


def _matched_by_blocks(drivers: DataFrame, word_sets: DataFrame, postings: DataFrame) -> DataFrame:
    """The matches of variants that enter stored postings by one term each; few candidates are sent to the word sets."""
    terms = [r[0] for r in drivers.select("term").distinct().limit(PRUNE_AT_MOST + 1).collect()]
    rows = postings.where(F.col("term").isin(terms)) if len(terms) <= PRUNE_AT_MOST else postings
    rows = rows.join(small(drivers), "term")
    if "f_knowledge_base_id" in drivers.columns:
        rows = rows.where(F.col("f_knowledge_base_id").isNull() | (F.col("f_knowledge_base_id") == F.col("knowledge_base_id")))
    few = rows.agg(F.coalesce(F.sum("found"), F.lit(0))).first()[0] <= BROADCAST_ROWS
    filters = [c for c in drivers.columns if c.startswith("f_")]
    found = rows.select("query_id", "variant_no", "need", *filters, "block", F.explode("items").alias("item"))
    found = found.select("query_id", "variant_no", "need", *filters, (F.shiftleft("block", BLOCK) + F.col("item")).alias("serial"))
    held = (F.broadcast(found) if few else found).join(word_sets.select("serial", "chunk_id", *SCOPES, "chunk_index", "terms"), "serial")
    held = held.where((F.size(F.array_except("need", "terms")) == 0) & _filters_hold(held))
    return held.select("query_id", "variant_no", "chunk_id", "doc_uid", "chunk_index")


def chunk_grams(chunks: DataFrame, folder: str | None = None) -> GramIndex:
    """The n-gram index of the chunks' lower-cased texts."""
    return build_grams(chunks.select(*_numbers(chunks), "chunk_id", *SCOPES, "chunk_index", "updated_at", "content"), F.lower("content"), folder, "content")


def section_grams(sections: DataFrame, folder: str | None = None) -> GramIndex:
    """The n-gram index of the sections' titles and texts, lower-cased and without spaces."""
    squeezed = tx.remove_spaces(F.lower(F.concat_ws(" ", "section_title", "content")))
    return build_grams(sections.select(*_numbers(sections), "doc_uid", "knowledge_base_id", "section_no", "section_title", "content"), squeezed, folder, "section_title", "content")


def substring_fallback(variants: DataFrame, matched: DataFrame, chunks: DataFrame, grams: GramIndex | None = None) -> DataFrame:
    """Case-insensitive containment, only for variants without a full-text match.

    Every distinct text is looked up once in the n-gram index (``grams``, the stored one where there is one),
    whatever the number of variants that ask for it; filters and scopes hold on what it finds.
    """
    open_variants = variants.join(matched.select("query_id", "variant_no").distinct(), ["query_id", "variant_no"], "left_anti")
    needles = cut_lineage(_with_filters(open_variants, ()).withColumn("needle", F.lower("text")).drop("text"))
    grams = chunk_grams(chunks) if grams is None else grams
    hits = find_needles(needles.select("needle").distinct(), grams, ["chunk_id", *SCOPES, "chunk_index", "updated_at"])
    joined = hits.join(needles, "needle")
    return joined.where(_filters_hold(joined)).select("query_id", "variant_no", "chunk_id", "doc_uid", "chunk_index", "updated_at")


def fulltext_search(
    queries: DataFrame, chunks: DataFrame, k: int = 10, dictionary: TermDictionary = DEFAULT_DICTIONARY
) -> DataFrame:
    """First k chunks per query: variants in order, k per variant, distinct by chunk.

    Matches come in (doc_uid, chunk_index) order, fallback matches newest first.
    """
    return fulltext_hits(queries, chunks, chunk_word_sets(chunks, dictionary), k, dictionary)


def fulltext_hits(
    queries: DataFrame,
    chunks: DataFrame,
    word_sets: DataFrame,
    k: int | None = 10,
    dictionary: TermDictionary = DEFAULT_DICTIONARY,
    postings: DataFrame | None = None,
    frequencies: DataFrame | None = None,
    grams: GramIndex | None = None,
    variants_limit: int = 6,
) -> DataFrame:
    """``fulltext_search`` over stored index tables, where there are any; without ``k`` each query has its own ``fulltext_k``."""
    # Variants and matches are each read several times below.
    variants = cut_lineage(nz.expand_queries(queries, dictionary, limit=variants_limit))
    matched = cut_lineage(fulltext_match(variants, word_sets, postings=postings, frequencies=frequencies))
    fallback = substring_fallback(variants, matched, chunks, grams=grams)
    both = matched.withColumn("newest", F.lit(None).cast("timestamp")).unionByName(
        fallback.withColumnRenamed("updated_at", "newest")
    )
    per_variant = Window.partitionBy("query_id", "variant_no").orderBy(F.desc_nulls_last("newest"), "doc_uid", "chunk_index")
    if k is None:
        both, limit = both.join(queries.select("query_id", "fulltext_k"), "query_id"), F.col("fulltext_k")
    else:
        both, limit = both.withColumn("fulltext_k", F.lit(k)), F.lit(k)
    top = both.withColumn("pos", F.row_number().over(per_variant)).where(F.col("pos") <= limit)
    first = top.groupBy("query_id", "chunk_id").agg(
        F.min(F.struct("variant_no", "pos", "doc_uid")).alias("m"), F.first("fulltext_k").alias("fulltext_k")
    )
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("m.variant_no", "m.pos")))
    return ranked.where(F.col("rank") <= F.col("fulltext_k")).select(
        "query_id",
        "rank",
        "chunk_id",
        F.col("m.doc_uid").alias("doc_uid"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("double").alias("rerank_score"),
        F.lit("fulltext").alias("retrieval_source"),
        F.array(F.lit("fulltext")).alias("matched_sources"),
    )


# --------------------------------------------------------------------------- merging
def hybrid_search(fulltext: DataFrame, vector: DataFrame, k: int = 10) -> DataFrame:
    """Full-text order first, then vector-only hits; a chunk found by both is ``hybrid``."""
    return merged_hits(fulltext, vector).where(F.col("rank") <= k)


def merged_hits(fulltext: DataFrame, vector: DataFrame) -> DataFrame:
    """All hits of both lists in hybrid order, as reranking gets them before the cut."""
    f = fulltext.select("query_id", "chunk_id", F.col("rank").alias("f_rank"), F.col("doc_uid").alias("f_doc"), F.col("score").alias("f_score"))
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("v_rank"), F.col("doc_uid").alias("v_doc"), F.col("score").alias("v_score"))
    both = f.join(v, ["query_id", "chunk_id"], "full_outer")
    shared = F.col("f_rank").isNotNull() & F.col("v_rank").isNotNull()
    merged = both.select(
        "query_id",
        "chunk_id",
        F.coalesce("f_doc", "v_doc").alias("doc_uid"),
        F.when(shared, F.greatest(F.coalesce("f_score", F.lit(0.0)), F.col("v_score")))
        .otherwise(F.coalesce("f_score", "v_score"))
        .alias("score"),
        F.lit(None).cast("double").alias("rerank_score"),
        F.when(shared, "hybrid").when(F.col("f_rank").isNotNull(), "fulltext").otherwise("vector").alias("retrieval_source"),
        F.array_compact(
            F.array(F.when(F.col("f_rank").isNotNull(), "fulltext"), F.when(F.col("v_rank").isNotNull(), "vector"))
        ).alias("matched_sources"),
        "f_rank",
        "v_rank",
    )
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("f_rank"), F.asc_nulls_last("v_rank"), "chunk_id")
    return merged.withColumn("rank", F.row_number().over(order)).select(*HIT_COLUMNS)


def attach_metadata(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with document columns; hits without a document drop, missing text is empty."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    meta = docs.select(
        "doc_uid",
        "knowledge_base_id",
        blank("doc_title"),
        blank("author"),
        blank("source_name"),
        F.coalesce(F.from_json("tags_json", "array<string>"), F.array().cast("array<string>")).alias("tags"),
    )
    return hits.join(meta, "doc_uid")


def preview_results(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Result rows with a 200-character preview, highlighted terms and the result count."""
    rows = hits.join(chunks.select("chunk_id", "content", "source_span", "section_title"), "chunk_id").join(
        queries.select("query_id", "text"), "query_id"
    )
    preview = F.substring("content", 1, 200)
    return rows.select(
        "query_id",
        "rank",
        "chunk_id",
        "doc_uid",
        "source_span",
        "retrieval_source",
        preview.alias("content_preview"),
        nz.highlighted(preview, nz.search_terms(F.col("text"))).alias("content_preview_highlighted"),
        F.count(F.lit(1)).over(Window.partitionBy("query_id")).alias("result_count"),
    )


def apply_rerank(hits: DataFrame, scores: DataFrame, k: int | None = 10) -> DataFrame:
    """Reorder by supplied scores (query_id, item_index, relevance_score); without ``k`` nothing is cut.

    The index is the 0-based rank; one out of range, or an unscored hit, drops.  A query
    without usable scores, or with one hit, keeps its order.
    """
    joined = hits.withColumn("item_index", F.col("rank") - 1).join(scores, ["query_id", "item_index"], "left")
    q = Window.partitionBy("query_id")
    usable = joined.withColumn("scored", F.count("relevance_score").over(q)).withColumn("n", F.count(F.lit(1)).over(q))
    use = (F.col("scored") > 0) & (F.col("n") > 1)
    kept = usable.where(~use | F.col("relevance_score").isNotNull()).withColumn(
        "new_score", F.when(use, F.col("relevance_score"))
    )
    order = q.orderBy(F.desc_nulls_last("new_score"), "rank")
    return (
        kept.withColumn("new_rank", F.row_number().over(order))
        .where(F.lit(True) if k is None else F.col("new_rank") <= k)
        .select("query_id", F.col("new_rank").alias("rank"), "chunk_id", "doc_uid", "score", F.col("new_score").alias("rerank_score"), "retrieval_source", "matched_sources")
    )


# --------------------------------------------------------------------------- context
def expand_context(
    evidence: DataFrame,
    chunks: DataFrame,
    sections: DataFrame,
    *,
    neighbor_window: int | None = None,
    include_section_context: bool | None = None,
    section_max_chars: int | None = None,
) -> DataFrame:
    """Evidence rows with their neighbouring chunks and, if asked, a section excerpt.

    The limits may be columns of the evidence (one policy per check) or keywords.  Each
    piece of evidence looks up its 2w+1 neighbours by (document, index): the work follows
    the evidence, not the corpus, and one long section is never gathered into a task.
    """
    window = F.col("neighbor_window") if neighbor_window is None else F.lit(neighbor_window)
    with_section = F.col("include_section_context") if include_section_context is None else F.lit(include_section_context)
    max_chars = F.col("section_max_chars") if section_max_chars is None else F.lit(section_max_chars)

    base = evidence.join(
        chunks.select("chunk_id", "section_id", "section_no", "chunk_index", "section_title", "source_span", "content", "doc_title"), "chunk_id"
    ).withColumn("w", window)
    wanted = base.select("doc_uid", "section_no", "chunk_index", "w").distinct().select(
        "doc_uid",
        "section_no",
        "chunk_index",
        "w",
        F.explode(F.sequence(F.greatest(F.col("chunk_index") - F.col("w"), F.lit(0)), F.col("chunk_index") + F.col("w"))).alias("near"),
    )
    near = chunks.select("doc_uid", "section_no", F.col("chunk_index").alias("near"), F.concat(F.lit("["), "source_span", F.lit("] "), "content").alias("line"))
    around = (
        wanted.where("w > 0")
        .join(near, ["doc_uid", "section_no", "near"])
        .groupBy("doc_uid", "section_no", "chunk_index", "w")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("near", "line"))), lambda s: s["line"]), "\n").alias("around"))
    )
    texts = sections.select("doc_uid", "section_no", F.col("content").alias("section_content"))
    rows = base.join(around, ["doc_uid", "section_no", "chunk_index", "w"], "left").join(texts, ["doc_uid", "section_no"], "left")
    core = F.coalesce("around", "content")
    use_section = with_section & (F.coalesce("section_content", F.lit("")) != "")
    excerpt = F.substring(F.col("section_content"), F.lit(1), max_chars)
    return (
        rows.withColumn(
            "expanded_content",
            F.when(use_section, tx.strip(F.concat(core, F.lit("\n\n[章节上下文] "), excerpt))).otherwise(core),
        )
        .withColumn(
            "context_mode",
            F.when(use_section, "section_context").when(F.col("w") > 0, "neighbor_chunks").otherwise("chunk"),
        )
        .drop("around", "section_content", "w")
    )


def chunk_detail(chunks: DataFrame, docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunk, its document (must exist) and its section title (may be absent)."""
    return (
        chunks.drop("doc_title", "section_title", "knowledge_base_id")
        .join(docs.select("doc_uid", "knowledge_base_id", "doc_title", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("source_name", F.lit("")).alias("source_name")), "doc_uid")
        .join(sections.select("section_id", "section_title"), "section_id", "left")
    )


# ------------------------------------------------------------------- claim candidates
def gathering_limits(policy: dict = CHECK_POLICY) -> dict[str, int]:
    """Per-query and per-source limits used while gathering candidates for a claim."""
    floor = max(int(policy["final_top_k"]), 4)
    per_query = max(floor + 1, 5)
    return {
        "per_query": per_query,
        "fulltext": max(int(policy["fulltext_top_k"]), per_query + 1),
        "vector": max(int(policy["vector_top_k"]), per_query + 1),
        "floor": floor,
    }


def merge_candidates(hits: DataFrame) -> DataFrame:
    """Hits of all labelled queries of a claim, one row per chunk.

    ``hits`` is (claim_id, query_no, label, …hits).  Ties later on are broken by the place a
    chunk was first seen, kept as ``first_seen``.
    """
    return (
        hits.groupBy("claim_id", "chunk_id")
        .agg(
            F.first("doc_uid").alias("doc_uid"),
            F.array_sort(F.collect_set("label")).alias("matched_queries"),
            F.array_sort(
                F.array_distinct(F.flatten(F.collect_set(F.array_union("matched_sources", F.array("retrieval_source")))))
            ).alias("matched_sources"),
            F.max("rerank_score").alias("rerank_score"),
            F.min(F.struct("query_no", "rank", "retrieval_source")).alias("first_seen"),
        )
        .withColumn("retrieval_source", F.col("first_seen.retrieval_source"))
    )


def rank_candidates(candidates: DataFrame, queries: DataFrame, final_top_k=None) -> DataFrame:
    """Best candidates per claim: labels, sources, score; at most max(2f, 2·queries, 8)."""
    counts = queries.groupBy("claim_id").agg(F.count(F.lit(1)).alias("query_count"))
    rows = candidates.join(counts, "claim_id")
    f = F.greatest(F.col("final_top_k") if final_top_k is None else F.lit(final_top_k), F.lit(4))
    order = Window.partitionBy("claim_id").orderBy(
        F.desc(F.size("matched_queries")),
        F.desc(F.size("matched_sources")),
        F.desc(F.coalesce("rerank_score", F.lit(0.0))),
        "first_seen.query_no",
        "first_seen.rank",
        "chunk_id",
    )
    return (
        rows.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.greatest(f * 2, F.col("query_count") * 2, F.lit(8)))
        .drop("query_count")
    )


# -------------------------------------------------------------------- section search
def score_sections(
    questions: DataFrame,
    sections: DataFrame,
    *,
    limit: int = 30,
    lexicon: QuestionLexicon = QuestionLexicon(),
    by: tuple[str, ...] = ("question_id", "doc_uid"),
    grams: GramIndex | None = None,
) -> DataFrame:
    """Sections scored against each question's terms, best ``limit`` per question and document.

    ``questions`` is (question_id, terms, doc_uid or knowledge_base_id).  Every distinct term is looked up once in
    the n-gram index of the sections (``grams``, the stored one where there is one); what holds it is joined to
    the questions that ask for it in that scope.
    """
    scope = [c for c in ("doc_uid", "knowledge_base_id") if c in questions.columns]
    terms = (
        questions.select("question_id", *scope, F.explode("terms").alias("term"))
        .select("question_id", *scope, tx.remove_spaces(F.lower("term")).alias("needle"))
        .where("needle <> ''")
    )
    terms = cut_lineage(terms)
    grams = section_grams(sections) if grams is None else grams
    found = find_needles(terms.select("needle").distinct(), grams, ["doc_uid", "knowledge_base_id", "section_no"])
    meta = sections.select("doc_uid", "section_no", "section_title", "section_level", "source_start_line", "source_anchor")
    title = tx.remove_spaces(F.lower("section_title"))
    others = [c for c in ("doc_uid", "knowledge_base_id") if c not in scope]
    per_term = (
        found.select("needle", "doc_uid", "section_no", *[c for c in ["knowledge_base_id"] if c not in others])
        .join(terms, ["needle", *scope])
        .join(meta, ["doc_uid", "section_no"])
        .withColumn("points", F.when(F.contains(title, F.col("needle")), 4).otherwise(2))
    )
    summed = per_term.groupBy(
        "question_id", "doc_uid", "section_no", "section_title", "section_level", "source_start_line", "source_anchor"
    ).agg(F.sum("points").alias("raw_score"))
    generic = contains_any(F.col("section_title"), lexicon.front_matter)
    penalty = (
        F.when(generic, 8).otherwise(0)
        + F.when(generic & (F.col("source_start_line") > 0) & (F.col("source_start_line") <= 80), 4).otherwise(0)
        + F.when(F.col("section_title").rlike(r"/\d+"), 6).otherwise(0)
    )
    scored = summed.withColumn("score", F.greatest(F.col("raw_score") - penalty, F.lit(0))).where("score > 0")
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "section_level", "source_start_line", "doc_uid", "section_no")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def is_incidental(term: Column, text: Column, markers) -> Column:
    """Whether the first mention of the term stands in a context that only names it in passing."""
    at = F.position(term, text)
    start = F.greatest(at - 1 - 18, F.lit(0))
    stop = at - 1 + F.length(term) + 24
    return contains_any(F.substring(text, start + 1, stop - start), markers)


def supplement_chunks(
    questions: DataFrame,
    chunks: DataFrame,
    *,
    limit: int = 2,
    per_term: int = 3,
    lexicon: QuestionLexicon = QuestionLexicon(),
    dictionary: TermDictionary = DEFAULT_DICTIONARY,
    word_sets: DataFrame | None = None,
    grams: GramIndex | None = None,
) -> DataFrame:
    """Extra chunk evidence within a question's document.

    ``questions`` is (question_id, question, terms, chunk_terms, doc_uid).  Per term the first
    ``per_term`` matches (by full text, else by containment) are looked at, then filtered;
    the first ``limit`` distinct chunks in term order stay.
    """
    terms = questions.select(
        F.concat_ws("\u0001", F.col("question_id").cast("string"), "doc_uid").alias("query_id"),
        "question_id",
        "doc_uid",
        F.array_contains("terms", lexicon.subject).alias("needs_subject"),
        F.posexplode("chunk_terms").alias("term_no", "text"),
    ).withColumn("variant_no", F.col("term_no") + 1)
    terms = cut_lineage(terms)
    variants = terms.select("query_id", "variant_no", "text", "doc_uid")
    word_sets = chunk_word_sets(chunks, dictionary) if word_sets is None else word_sets
    matched = cut_lineage(fulltext_match(variants, word_sets, scope=["doc_uid"]))
    fallback = substring_fallback(variants, matched, chunks, grams=grams).drop("updated_at")
    first = Window.partitionBy("query_id", "variant_no").orderBy("chunk_index")
    looked_at = matched.unionByName(fallback).withColumn("pos", F.row_number().over(first)).where(F.col("pos") <= per_term)
    rows = looked_at.join(terms.drop("doc_uid", "term_no"), ["query_id", "variant_no"]).join(
        chunks.select("chunk_id", "content", "source_span", "source_anchor"), "chunk_id"
    )
    text, term = F.col("content"), F.col("text")
    kept = rows.where(
        F.contains(text, term)
        & (~F.col("needs_subject") | F.contains(text, F.lit(lexicon.subject)))
        & ~is_incidental(term, text, lexicon.incidental)
    )
    best = kept.groupBy("question_id", "doc_uid", "chunk_id").agg(
        F.min(F.struct("variant_no", "pos", "text", "content", "source_span", "source_anchor")).alias("m")
    )
    order = Window.partitionBy("question_id", "doc_uid").orderBy("m.variant_no", "m.pos", "chunk_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select("question_id", "doc_uid", "rank", "chunk_id", F.col("m.text").alias("term"), "m.source_span", "m.source_anchor", "m.content")
    )


EVIDENCE_COLUMNS = ["question_id", "doc_uid", "source_type", "title", "position", "source_anchor", "chunk_id", "content", "part", "rank"]
# Source types and titles of evidence.
SECTION_SOURCE = "PageIndex 节点"
CHUNK_SOURCE = "RAG/FTS 原文"
CHUNK_TITLE = "RAG/FTS 原文片段"


def section_evidence(scored: DataFrame, sections: DataFrame, take: int = 3) -> DataFrame:
    picked = scored.where(F.col("rank") <= take).join(sections.select("doc_uid", "section_no", "content"), ["doc_uid", "section_no"])
    return picked.select(
        "question_id",
        "doc_uid",
        F.lit(SECTION_SOURCE).alias("source_type"),
        F.col("section_title").alias("title"),
        F.col("source_anchor").alias("position"),
        F.lit("").alias("source_anchor"),
        F.lit("").alias("chunk_id"),
        "content",
        F.lit(1).alias("part"),
        "rank",
    )


def chunk_evidence(supplements: DataFrame) -> DataFrame:
    return supplements.select(
        "question_id",
        "doc_uid",
        F.lit(CHUNK_SOURCE).alias("source_type"),
        F.lit(CHUNK_TITLE).alias("title"),
        F.col("source_span").alias("position"),
        "source_anchor",
        "chunk_id",
        "content",
        F.lit(2).alias("part"),
        "rank",
    )


def merge_evidence(primary: DataFrame, supplemental: DataFrame) -> DataFrame:
    """Union, distinct by (source type, document, chunk else position else title); first wins."""
    key = F.coalesce(F.nullif("chunk_id", F.lit("")), F.nullif("position", F.lit("")), "title")
    rows = primary.unionByName(supplemental).withColumn("evidence_key", key)
    names = [c for c in EVIDENCE_COLUMNS if c not in ("question_id", "doc_uid", "source_type", "part", "rank")]
    first = rows.groupBy("question_id", "source_type", "doc_uid", "evidence_key").agg(
        F.min(F.struct("part", "rank", *names)).alias("m")
    )
    merged = first.select("question_id", "doc_uid", "source_type", "evidence_key", "m.*")
    order = [(c, "asc") for c in ("doc_uid", "part", "rank")]
    return ranked(merged, ["question_id"], order, "position_no").withColumn("position_no", F.col("position_no").cast("int"))


def rank_sections_local(
    questions: DataFrame,
    sections: DataFrame,
    chunks: DataFrame,
    *,
    candidates: int = 30,
    take: int = 3,
    supplements: int = 2,
    lexicon: QuestionLexicon = QuestionLexicon(),
    dictionary: TermDictionary = DEFAULT_DICTIONARY,
    word_sets: DataFrame | None = None,
    section_index: GramIndex | None = None,
    chunk_index: GramIndex | None = None,
) -> DataFrame:
    """Best sections and chunk supplements per question and document, merged.

    ``questions`` is (question_id, question, doc_uid).
    """
    question = F.col("question")
    raw = nz.question_terms(question, lexicon)
    planned = (
        questions.withColumn("terms", raw)
        .withColumn("chunk_terms", nz.chunk_terms(F.col("terms"), question, lexicon, dictionary))
        .withColumn("section_terms", nz.tree_terms(F.col("terms"), lexicon))
    )
    scored = score_sections(planned.select("question_id", "doc_uid", F.col("section_terms").alias("terms")), sections, limit=candidates, lexicon=lexicon, grams=section_index)
    extra = supplement_chunks(planned, chunks, limit=supplements, lexicon=lexicon, dictionary=dictionary, word_sets=word_sets, grams=chunk_index)
    return merge_evidence(section_evidence(scored, sections, take), chunk_evidence(extra))


def collect_kb_evidence(questions: DataFrame, docs: DataFrame, sections: DataFrame, chunks: DataFrame, **limits) -> DataFrame:
    """One question against every completed document of its knowledge base, merged.

    ``questions`` is (question_id, question, knowledge_base_id).
    """
    completed = docs.where("ingest_status = 'completed'").select("doc_uid", "knowledge_base_id")
    scoped = questions.join(completed, "knowledge_base_id").drop("knowledge_base_id")
    return rank_sections_local(scoped, sections, chunks, **limits)


def available_documents(docs: DataFrame) -> DataFrame:
    """Completed documents per knowledge base, newest first; a knowledge base of any size is ranked in many tasks."""
    rows = docs.where("ingest_status = 'completed'").select("knowledge_base_id", "doc_uid", "doc_title", "updated_at")
    order = [("updated_at", "desc"), ("doc_title", "asc"), ("doc_uid", "asc")]
    return ranked(rows, ["knowledge_base_id"], order).withColumn("position", F.col("position").cast("int")).drop("updated_at")


def query_history(history: DataFrame, limit: int = 20, by: str = "knowledge_base_id") -> DataFrame:
    """Stored questions per knowledge base (or per document, ``by="doc_uid"``), newest first, with the type read from the debug text."""
    order = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("query_id"))
    evidence = F.from_json("evidence_json", "array<struct<doc_uid:string,title:string>>")
    return (
        history.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
        .select(
            by,
            "position",
            "query_id",
            "question",
            "answer",
            F.coalesce(F.get_json_object("debug_json", "$.question_plan.question_type"), F.lit("unknown")).alias("question_type"),
            F.coalesce(F.size(evidence), F.lit(0)).alias("evidence_count"),
            F.coalesce(F.get(evidence, F.lit(0))["doc_uid"], F.lit("")).alias("first_doc"),
        )
    )
