"""Checking a table of texts against the corpus: claims, rules, evidence, verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.plugins import Judge, Reranker, judge_with
from attestry.functions.session import cut_lineage, stored
from attestry.lexicons import CHECK_POLICY, ClaimLexicon
from attestry.operators import claims as cl
from attestry.operators import normalize as nz
from attestry.operators import retrieval as rt
from attestry.plans.corpus import Corpus
from attestry.plans.search import search_by_limits


@dataclass(frozen=True)
class CheckResult:
    """Tables of one run over all texts."""

    checks: DataFrame
    claims: DataFrame
    rule_hits: DataFrame
    evidence: DataFrame


def with_policy(texts: DataFrame, policy: dict = CHECK_POLICY) -> DataFrame:
    """The texts with all limits as columns: their own where they have one, else those of ``policy``."""
    own = lambda n, d: F.coalesce(F.col(n), F.lit(d)) if n in texts.columns else F.lit(d)
    return texts.withColumns({n: own(n, d) for n, d in policy.items()})


def labelled_hits(
    claims: DataFrame, corpus: Corpus, policy: dict = CHECK_POLICY, lexicon: ClaimLexicon = ClaimLexicon(), reranker: Reranker | None = None
) -> tuple[DataFrame, DataFrame]:
    """The hits of all labelled queries of the claims, and the queries: (claim_id, query_no, label, …hits) and
    (claim_id, query_no, label, text, final_top_k).  Claims may carry limits of their own."""
    limits = with_policy(claims, policy).select("claim_id", *policy)
    labelled = nz.build_retrieval_queries(claims, lexicon, corpus.dictionary).join(limits, "claim_id")
    per_query = F.greatest(F.greatest(F.col("final_top_k"), F.lit(4)) + 1, F.lit(5))
    queries = labelled.withColumns(
        {
            "query_id": F.concat_ws(":", "claim_id", F.col("query_no").cast("string")),
            "k": per_query,
            "fulltext_k": F.greatest(F.col("fulltext_top_k"), per_query + 1),
            "vector_k": F.greatest(F.col("vector_top_k"), per_query + 1),
        }
    )
    queries = stored(queries.drop("neighbor_window", "include_section_context", "section_max_chars"), "labelled")
    return search_by_limits(queries, corpus, reranker, ["claim_id", "query_no", "label"], True), queries


def gather_evidence(
    claims: DataFrame, corpus: Corpus, policy: dict = CHECK_POLICY, lexicon: ClaimLexicon = ClaimLexicon(), reranker: Reranker | None = None
) -> DataFrame:
    """Ranked candidate chunks per claim, from all its labelled queries, with the claim's limits."""
    hits, queries = labelled_hits(claims, corpus, policy, lexicon, reranker)
    limits = with_policy(claims, policy).select("claim_id", *policy)
    return rt.rank_candidates(rt.merge_candidates(hits).join(limits, "claim_id"), queries)


def run_check(
    texts: DataFrame,
    corpus: Corpus,
    rules: DataFrame,
    *,
    policy: dict = CHECK_POLICY,
    tags: str | None = None,
    lexicon: ClaimLexicon = ClaimLexicon(),
    reranker: Reranker | None = None,
    judge: Judge | None = None,
    prompt: str = cl.USER_PROMPT,
    excerpt_chars: int = 200,
) -> CheckResult:
    """``texts`` is (check_id, input_text) with optional doc_uid / knowledge_base_id filters and limits.

    Every check has its own policy: limits that are columns of the texts hold for it, null or missing ones come from
    ``policy``; ``tags`` names a column with the tags whose rules apply.  Checks with ``use_rerank`` have their hits
    scored by the reranker before the cut.  With a judge its verdict is merged with the heuristic one, the more
    conservative stays; where it fails the heuristic one does.  All checks run in one plan.

    The gathered candidates are written to the checkpoint folder once, because counts,
    verdicts and evidence rows all read them.
    """
    claims = cut_lineage(cl.split_claims(with_policy(texts.where(F.length(F.trim("input_text")) > 0), policy)))
    rule_hits = cl.match_rules(claims, rules, tags)
    candidates = gather_evidence(claims, corpus, policy, lexicon, reranker)
    expanded = rt.expand_context(candidates, corpus.chunks, corpus.sections)
    annotated = cl.annotate_relations(expanded, claims, lexicon)
    selected = cut_lineage(cl.select_evidence(annotated))
    plain = claims.drop(*policy)
    verdicts = cl.heuristic_verdict(plain, selected, rule_hits, lexicon)
    if judge is not None:
        said = ["verdict", "confidence", "risk_level", "evidence_judgement", "reason"]
        merged = judge_with(cl.build_prompts(plain, selected, rule_hits, prompt, lexicon), verdicts, judge).select("claim_id", *said)
        verdicts = cut_lineage(verdicts.drop(*said).join(merged, "claim_id"))
    first = selected.where("selected_no = 1").select(
        "claim_id",
        F.substring("evidence_text", 1, excerpt_chars).alias("evidence"),
        F.col("doc_uid").alias("source_doc"),
        "source_span",
    )
    keep = [c for c in ("doc_uid", "knowledge_base_id") if c in texts.columns]
    claim_rows = (
        verdicts.join(first, "claim_id", "left")
        .join(cl.evidence_details(selected), "claim_id", "left")
        .withColumn("evidence", F.coalesce("evidence", F.lit("未检索到足够证据，需人工复核")))
        .withColumn("review_status", F.lit("pending"))
    )
    if "doc_uid" in keep:  # without evidence the document that was asked for
        asked = claims.select("claim_id", F.col("doc_uid").alias("asked_doc"))
        claim_rows = claim_rows.join(asked, "claim_id").withColumn("source_doc", F.coalesce("source_doc", "asked_doc")).drop("asked_doc")
    checks = (
        texts.select("check_id", "input_text", *keep)
        .join(cl.overall_verdict(verdicts), "check_id")
        .join(cl.overall_risk(verdicts), "check_id")
        .join(cl.check_summary(verdicts, rule_hits), "check_id")
    )
    return CheckResult(checks, claim_rows, rule_hits, selected)
