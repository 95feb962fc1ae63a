"""Search plans: full text, vectors and both over a stored corpus."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.plugins import Reranker, rerank_with
from attestry.functions.session import stored
from attestry.operators import retrieval, vectors
from attestry.operators.shelves import search_shelves
from attestry.plans.corpus import Corpus


def search_fulltext(queries: DataFrame, corpus: Corpus, k: int | None = 10) -> DataFrame:
    return retrieval.fulltext_hits(queries, corpus.chunks, corpus.word_sets, k, corpus.dictionary, corpus.postings, corpus.frequencies, corpus.chunk_grams)


def search_vector(queries: DataFrame, corpus: Corpus, k: int = 10) -> DataFrame:
    """The nearest vectors among those whose document exists."""
    keep = [c for c in ("doc_uid", "knowledge_base_id") if c in queries.columns]
    embedded = queries.select("query_id", *keep, vectors.hash_vector(queries["text"]).alias("embedding"))
    return vectors.vector_search(embedded, corpus.vectors.join(corpus.docs.select("doc_uid"), "doc_uid", "left_semi"), k)


def search_hybrid(
    queries: DataFrame, corpus: Corpus, k: int = 10, fulltext_k: int | None = None, vector_k: int | None = None, reranker: Reranker | None = None
) -> DataFrame:
    """Both searches merged; with a reranker all merged hits are scored before the cut to k."""
    if reranker is None:
        return retrieval.hybrid_search(search_fulltext(queries, corpus, fulltext_k or k), search_vector(queries, corpus, vector_k or k), k)
    limits = {"k": k, "fulltext_k": fulltext_k or k, "vector_k": vector_k or k, "use_rerank": True}
    return search_by_limits(queries.withColumns({n: F.lit(v) for n, v in limits.items()}), corpus, reranker)


def search_by_limits(queries: DataFrame, corpus: Corpus, reranker: Reranker | None = None, keep: Sequence[str] = (), kept: bool = False) -> DataFrame:
    """Hybrid search in which every query has its own ``k``, ``fulltext_k``, ``vector_k`` and ``use_rerank``.

    One plan for all queries; each query's own limit cuts the lists, which are in order. Queries that ask for it are
    reranked before the cut. Queries that name a knowledge base, and no document, are answered from its shelf. ``keep``
    names further columns of the queries that the hits carry; queries that are stored already (``kept``) aren't stored again.
    """
    queries = queries if kept else stored(queries, "asked")
    keep = list(dict.fromkeys(["query_id", *keep]))
    parts = []
    if "knowledge_base_id" in queries.columns and "doc_uid" not in queries.columns and corpus.shelves:
        scoped = queries.where(F.col("knowledge_base_id").isNotNull())
        merged = search_shelves(scoped, corpus.shelves, corpus.dictionary, reranker is None, keep if reranker is None else ["query_id"])
        if reranker is not None:
            merged = _reranked(merged, scoped, corpus, reranker).join(scoped.select(*keep, "k"), "query_id").where(F.col("rank") <= F.col("k"))
        parts.append(merged)
        queries = queries.where(F.col("knowledge_base_id").isNull())
    if not parts or not queries.isEmpty():
        limits = queries.select("query_id", "vector_k")
        widest = limits.agg(F.coalesce(F.max("vector_k"), F.lit(1))).first()[0]
        vector = search_vector(queries, corpus, widest).join(limits, "query_id").where(F.col("rank") <= F.col("vector_k")).drop("vector_k")
        merged = retrieval.merged_hits(search_fulltext(queries, corpus, None), vector)
        merged = _reranked(merged, queries, corpus, reranker).join(queries.select(*keep, "k"), "query_id").where(F.col("rank") <= F.col("k"))
        parts.append(merged)
    columns = [*keep, *[c for c in retrieval.HIT_COLUMNS if c != "query_id"]]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def _reranked(merged: DataFrame, queries: DataFrame, corpus: Corpus, reranker: Reranker | None) -> DataFrame:
    """The merged hits with those of queries that ask for it in the reranker's order."""
    if reranker is None:
        return merged
    merged = stored(merged.select(*retrieval.HIT_COLUMNS), "merged")
    asked = queries.where("use_rerank").select("query_id")
    again = merged.join(asked, "query_id", "left_semi")
    scored = retrieval.apply_rerank(again, rerank_with(again, queries, corpus.chunks, reranker), None)
    return merged.join(asked, "query_id", "left_anti").unionByName(scored)
