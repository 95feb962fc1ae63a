"""Registered queries: sources, upkeep, reports, review, scope, evaluation, streams, scorers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.functions import plugins as pl
from attestry.functions.session import cut_lineage
from attestry.operators import claims as cl
from attestry.operators import evaluation as ev
from attestry.operators import ingest as ig
from attestry.operators import normalize as nz
from attestry.operators import reports as rp
from attestry.operators import retrieval as rt
from attestry.operators import review as rv
from attestry.operators import scope as sc
from attestry.operators.matching import contains_join
from attestry.plans import search
from attestry.plans.corpus import shared_folder
from attestry.sources import files as sf
from attestry.streaming import streams as ss
from verification import inputs as vi
from verification.inputs import Inputs
from verification.q_claims import checked, rule_hits, selected_texts, verdicts
from verification.registry import register


def fresh_folder(i: Inputs, name: str) -> str:
    return shared_folder(i.spark, f"{name}-{uuid.uuid4().hex[:8]}")


# ------------------------------------------------------------------ A. sources and upkeep
@register("scan_documents")
def scan_documents(i: Inputs):
    """Documents written as text files, one folder per knowledge base, then listed."""
    root = fresh_folder(i, "scan")
    sf.write_texts(i.docs.select("knowledge_base_id", "doc_uid", "content"), root)
    return sf.scan_documents(i.spark, root, "txt").select("knowledge_base_id", "file_type", "size_bytes")


def raw_files(i: Inputs):
    """Documents as file rows; every fifth is a JSON file, every 35th a broken one."""
    n = F.col("n")
    body = F.to_json(
        F.struct(
            F.concat(F.lit("Title "), n.cast("string")).alias("title"), F.col("content").alias("content"), F.when(n % 10 == 0, "2 nd").alias("edition"),
            F.col("author").alias("author"), F.when(n % 3 == 0, F.col("knowledge_base_id")).alias("source_name"), F.lit("a, b,,c").alias("tags"),
        )
    )
    is_json = n % 5 == 0
    path = F.concat("knowledge_base_id", F.lit("/File "), n.cast("string"), F.when(is_json, ".json").otherwise(".md"))
    return i.docs.select(path.alias("path"), F.when(n % 35 == 0, "[1, 2]").when(is_json, body).otherwise(F.col("content")).alias("value"))


@register("read_documents")
def read_documents(i: Inputs):
    rows = sf.documents_from_text(raw_files(i))
    return rows.select("source_path", "doc_uid", "doc_id", "doc_title", "edition", "author", "source_name", "tags", "source_hash", "ingest_status")


@register("extract_metadata")
def extract_metadata(i: Inputs):
    return ig.extract_metadata(i.docs.select(F.col("source_path").alias("path"), "content"))


@register("fingerprint_documents")
def fingerprint_documents(i: Inputs):
    return ig.fingerprint_documents(i.docs)


def incoming(i: Inputs):
    return i.docs.where("n % 9 <> 0").select("source_path", F.sha2("content", 256).alias("source_hash"), "knowledge_base_id")


def stored(i: Inputs):
    n = F.col("n")
    return i.docs.where("n % 10 <> 0").select(
        "source_path",
        F.when(n % 7 == 0, "old").otherwise(F.sha2("content", 256)).alias("source_hash"),
        F.when(n % 11 == 0, "other").otherwise(F.col("knowledge_base_id")).alias("knowledge_base_id"),
    )


@register("detect_changes")
def detect_changes(i: Inputs):
    return ig.detect_changes(incoming(i), stored(i))


def reconciled(i: Inputs):
    scanned = i.docs.where("n % 9 <> 0").select("source_path", F.length("content").alias("size_bytes"))
    return ig.reconcile_scan(scanned, i.docs.where("n % 10 <> 0").select("source_path", "doc_uid", "index_status"))


@register("reconcile_scan")
def reconcile_scan(i: Inputs):
    return reconciled(i)


@register("scan_totals")
def scan_totals(i: Inputs):
    return ig.scan_totals(reconciled(i))


def doc_rows(i: Inputs):
    return i.docs.select("doc_uid", "knowledge_base_id", "doc_title", "created_at", "updated_at")


@register("upsert_documents")
def upsert_documents(i: Inputs):
    """Two thirds stored; half come again under another title, an hour later."""
    n = F.substring("doc_uid", 2, 9).cast("int")
    again = doc_rows(i).where(n % 2 == 0).withColumn("doc_title", F.concat("doc_title", F.lit(" again")))
    later = again.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR")).withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 HOUR"))
    return ig.upsert_documents(doc_rows(i).where(n % 3 != 0), later)


@register("replace_derived_rows")
def replace_derived_rows(i: Inputs):
    """Chunks of every fourth document replaced by one chunk each."""
    n = F.substring("doc_uid", 2, 9).cast("int")
    rows = i.corpus.chunks.select("doc_uid", "chunk_index", "token_count")
    changed = i.corpus.docs.where(n % 4 == 0).select("doc_uid")
    return ig.replace_derived_rows(rows, changed, changed.select("doc_uid", F.lit(0).alias("chunk_index"), F.lit(1).alias("token_count")))


@register("rebuild_documents")
def rebuild_documents(i: Inputs):
    """Documents whose index is not complete, rebuilt: chunks and vectors per document."""
    made = ig.rebuild_documents(i.docs, i.docs.where("index_status <> 'indexed'"))
    count = lambda t, name: made[t].groupBy("doc_uid").agg(F.count(F.lit(1)).alias(name))
    return count("sections", "sections").join(count("chunks", "chunks"), "doc_uid").join(count("vectors", "vectors"), "doc_uid")


@register("reassign_knowledge_base")
def reassign_knowledge_base(i: Inputs):
    moves = i.docs.where("n % 6 = 0").select("doc_uid", F.lit("moved").alias("new_kb"))
    return ig.reassign_knowledge_base(i.docs.select("doc_uid", "knowledge_base_id"), moves)


@register("cascade_delete")
def cascade_delete(i: Inputs):
    """Checks of even number removed with their claims and reviews; what is left of each table."""
    tables = {"checks": i.review_checks.select("check_id"), "claims": i.review_claims.select("check_id", "claim_id"), "reviews": i.reviews.select("claim_id", "review_id")}
    left = ig.cascade_delete(tables, [("checks", "claims", "check_id"), ("claims", "reviews", "claim_id")], tables["checks"].where("check_id % 2 = 0"))
    one = lambda name, key: left[name].select(F.lit(name).alias("table_name"), F.col(key).alias("id"))
    return one("checks", "check_id").unionByName(one("claims", "claim_id")).unionByName(one("reviews", "review_id"))


def bases(i: Inputs):
    d = i.table("documents")
    kb = d.select(F.col("source").alias("knowledge_base_id")).distinct().unionByName(d.select(F.concat("source", F.lit("-empty")).alias("knowledge_base_id")).distinct())
    number = F.regexp_extract("knowledge_base_id", r"(\d+)", 1).cast("int")
    return kb.select(
        "knowledge_base_id", F.concat(F.lit("base "), "knowledge_base_id").alias("name"), (F.col("knowledge_base_id") == "src1-empty").alias("is_default"),
        F.timestamp_seconds(F.lit(vi.EPOCH) + number * 60).alias("created_at"), F.timestamp_seconds(F.lit(vi.EPOCH) + number * 61).alias("updated_at"),
    )


@register("guard_kb_delete")
def guard_kb_delete(i: Inputs):
    return ig.guard_kb_delete(bases(i), i.docs, i.review_checks, i.review_claims, i.reviews)


@register("set_default_kb")
def set_default_kb(i: Inputs):
    """Bases of even number written again; the one with the highest number asks to be default."""
    number = F.regexp_extract("knowledge_base_id", r"(\d+)", 1).cast("int")
    again = bases(i).where((number % 2 == 0) & ~F.col("knowledge_base_id").contains("empty"))
    return ig.set_default_kb(bases(i), again.withColumn("is_default", number >= 10).withColumn("name", F.upper("name")))


@register("kb_listing")
def kb_listing(i: Inputs):
    """Each base with its place in the list."""
    order = Window.orderBy(F.desc("is_default"), F.desc("updated_at"), "name")
    return ig.kb_listing(bases(i)).withColumn("place", F.row_number().over(order)).select("place", "knowledge_base_id")


@register("kb_lookup")
def kb_lookup(i: Inputs):
    """Every third document's request names no base or a blank one."""
    n = F.col("doc_id")
    asked = i.table("documents").select("doc_id", F.when(n % 3 == 0, F.lit(None)).when(n % 3 == 1, "").otherwise(F.col("source")).alias("knowledge_base_id"))
    return ig.kb_lookup(asked, bases(i))


@register("normalize_kb_id")
def normalize_kb_id(i: Inputs):
    """Lines of documents as names."""
    names = i.table("conversations").select("conv_id", "turn", F.concat(F.lit(" _"), F.regexp_replace("text", "[a-m]", ".")).alias("name"))
    return ig.normalize_kb_id(names).select("conv_id", "turn", "kb_id", "valid")


@register("backfill_columns")
def backfill_columns(i: Inputs):
    rows = i.docs.select("doc_uid", F.when(F.col("n") % 8 == 0, " ").when(F.col("n") % 8 == 1, None).otherwise(F.col("knowledge_base_id")).alias("knowledge_base_id"))
    return ig.backfill_columns(rows, {"status": "active", "page_no": 0, "knowledge_base_id": "default"})


@register("append_job_log")
def append_job_log(i: Inputs):
    """Two stages logged by two appends."""
    folder = fresh_folder(i, "jobs")
    sf.append_job_log(ig.job_log(i.docs, "ingest"), folder)
    sf.append_job_log(ig.job_log(i.docs.where("index_status = 'indexed'"), "index"), folder)
    return i.spark.read.parquet(folder)


@register("write_check_result")
def write_check_result(i: Inputs):
    folder = fresh_folder(i, "results")
    v = cut_lineage(verdicts(i))
    sf.write_check_result(cl.overall_verdict(v), v.select("check_id", "claim_id", "verdict"), rule_hits(i), folder, "run-1")
    return sf.read_check_result(i.spark, folder, "claims").join(sf.read_check_result(i.spark, folder, "checks").drop("run_id"), "check_id")


@register("load_eval_cases")
def load_eval_cases(i: Inputs):
    """Benchmark items as JSON lines with blank, broken and non-object lines between."""
    good = F.to_json(F.struct(F.col("item_id").cast("string").alias("case_id"), F.col("text").alias("query"), F.array(F.lit("d")).alias("expected_doc_uids")))
    lines = F.array(good, F.lit(" "), F.concat(good, F.lit("x")), F.lit("[1]"), F.lit("7"))
    return sf.cases_from_lines(i.table("benchmark").select(F.explode(lines).alias("value"))).select("case_id", "query", "expected_doc_uids")


@register("load_rules")
def load_rules(i: Inputs):
    """One rule per source, written as JSON and read back."""
    folder = fresh_folder(i, "rules")
    d = i.table("documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("keywords"))
    d.orderBy("source").coalesce(1).select(F.col("source").alias("code"), F.concat(F.lit("rule "), "source").alias("name"), "keywords", F.lit("m").alias("message")).write.json(folder)
    return sf.load_rules(i.spark, folder).select("rule_no", "code", "name", "keywords", "hit_level", "message")


@register("load_term_dictionary")
def load_term_dictionary(i: Inputs):
    """Languages as entities with their sources as aliases."""
    folder = fresh_folder(i, "dictionary")
    e = i.table("documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("aliases"))
    entities = F.array_sort(F.collect_list(F.struct(F.col("lang").alias("canonical"), F.col("aliases"))))
    e.agg(entities.alias("entities"), F.create_map(F.lit("aa"), F.lit("b")).alias("variants")).coalesce(1).write.json(folder)
    return sf.dictionary_rows(i.spark, sf.load_term_dictionary(i.spark, f"{folder}/*.json"))


# ------------------------------------------------------------------ G. reports
def metrics(i: Inputs):
    c = i.corpus
    return rp.document_metrics(c.docs, c.sections, c.chunks, c.word_sets)


@register("document_metrics")
def document_metrics(i: Inputs):
    return metrics(i)


@register("sample_rows")
def sample_rows(i: Inputs):
    return rp.sample_rows(i.corpus.chunks, "doc_uid", "chunk_index", 4).select("doc_uid", "chunk_index", "chunk_id")


def quality(i: Inputs):
    """Vectors of every tenth document missing."""
    n = F.substring("doc_uid", 2, 9).cast("int")
    return rp.document_quality(i.corpus.docs, metrics(i), i.corpus.vectors.where(n % 10 != 0))


@register("document_quality")
def document_quality(i: Inputs):
    return quality(i).select("doc_uid", "issues", "quality_level", "quality_message")


@register("document_quality_batch")
def document_quality_batch(i: Inputs):
    return rp.document_quality_batch(quality(i))


@register("export_quality_csv")
def export_quality_csv(i: Inputs):
    folder = fresh_folder(i, "csv")
    sf.export_quality_csv(quality(i), i.corpus.docs, folder)
    return i.spark.read.option("header", True).csv(folder)


@register("quality_thresholds")
def quality_thresholds(i: Inputs):
    """Event values as threshold settings."""
    from attestry.lexicons import QUALITY_THRESHOLDS

    names = F.lit(list(QUALITY_THRESHOLDS))
    value = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, F.col("event_type")).otherwise(F.floor("value").cast("string"))
    return rp.threshold_rows(i.events.select(F.col("event_id").alias("setting_id"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("name"), value.alias("value")))


@register("database_summary")
def database_summary(i: Inputs):
    c = i.corpus
    return rp.database_summary(c.docs, c.sections, c.chunks, i.review_checks, i.review_claims, i.reviews)


@register("list_documents")
def list_documents(i: Inputs):
    rows = rp.list_documents(i.docs, knowledge_base_id="src3", status="completed", page=2, page_size=10)
    return rows.select("doc_uid", "doc_title", "index_status", "total")


def reviewed_claims(i: Inputs):
    return i.review_claims.join(rv.latest_review_status(i.review_claims, i.reviews).withColumnRenamed("reviewed_at", "updated_at"), "claim_id")


def recent(i: Inputs):
    return rp.recent_checks(i.review_checks, reviewed_claims(i), 3)


@register("recent_checks")
def recent_checks(i: Inputs):
    ids = F.array_join(F.transform("claims", lambda c: c["claim_id"].cast("string")), ",")
    return recent(i).select("check_id", "knowledge_base_id", "position", "pending_claim_count", ids.alias("claim_ids"))


@register("recent_claims")
def recent_claims(i: Inputs):
    return rp.recent_claims(recent(i)).drop("check_created_at")


@register("claim_detail")
def claim_detail(i: Inputs):
    c = F.col("claim_id")
    details = "array<struct<chunk_id:string,doc_uid:string,doc_title:string,source_span:string,retrieval_source:string,matched_sources:array<string>,matched_queries:array<string>,rerank_score:double,context_mode:string,section_title:string,evidence_relation:string,relation_reason:string,content_preview:string>>"
    rows = i.review_claims.select(
        c.cast("string").alias("claim_id"), "claim_text",
        F.when(c % 3 != 0, F.concat(F.lit("doc"), c.cast("string"))).alias("source_doc"), F.when(c % 6 == 1, "span").alias("source_span"), F.when(c % 5 == 0, "text").alias("evidence"),
        F.when(c % 2 == 0, "support").alias("evidence_judgement"), F.lit("why").alias("evidence_reason"), F.array().cast(details).alias("evidence_details"),
    )
    e = rp.claim_detail(rows).select("claim_id", F.explode_outer("evidence_details").alias("e"))
    return e.select("claim_id", "e.chunk_id", "e.doc_uid", "e.source_span", "e.context_mode", "e.evidence_relation", "e.relation_reason", "e.content_preview")


@register("get_check_result")
def get_check_result(i: Inputs):
    r = rp.get_check_result(i.texts.select("check_id"), verdicts(i), rule_hits(i))
    return r.select(
        "check_id", F.array_join(F.transform("claims", lambda c: c["verdict"]), ",").alias("verdicts"), F.array_join(F.transform("rule_hits", lambda h: h["rule_code"]), ",").alias("rules")
    )


@register("evidence_catalog")
def evidence_catalog(i: Inputs):
    """The whole catalog."""
    return rp.evidence_catalog(i.corpus.chunks, i.corpus.docs)


@register("evidence_catalog_page")
def evidence_catalog_page(i: Inputs):
    return rp.evidence_catalog(i.corpus.chunks, i.corpus.docs, knowledge_base_id="src2", query="THON", limit=200).select("doc_uid", "chunk_id", "chunk_index")


@register("paginate")
def paginate(i: Inputs):
    return rp.paginate(i.docs.select("doc_uid", "updated_at"), rp.NEWEST_DOCUMENTS, page=3, page_size=25).drop("updated_at")


# ------------------------------------------------------------------ H. review, I. scope
@register("submit_reviews")
def submit_reviews(i: Inputs):
    """All events as submissions; claims of users divisible by four do not exist."""
    sent = i.events.select(F.col("event_id").alias("review_id"), F.col("user_id").alias("claim_id"), F.when(F.col("event_type") == "click", "updated").when(F.col("event_type") == "error", "rejected").otherwise(F.col("event_type")).alias("review_action"))
    return rv.submit_reviews(sent, i.review_claims.where("claim_id % 4 <> 0"))


@register("latest_review_status")
def latest_review_status(i: Inputs):
    return rv.latest_review_status(i.review_claims, i.reviews).drop("reviewed_at")


@register("review_queue")
def review_queue(i: Inputs):
    return rv.review_queue(reviewed_claims(i), i.review_checks, 50).select("claim_id", "check_id", "review_status", "knowledge_base_id")


@register("filter_review_queue")
def filter_review_queue(i: Inputs):
    queue = rv.review_queue(reviewed_claims(i), i.review_checks, None)
    return rv.filter_review_queue(queue, "processed", "high").select("claim_id", "review_status", "risk_level", "side")


@register("delete_reviews")
def delete_reviews(i: Inputs):
    """Every purchase's review is taken back, and ids that are no reviews are asked for as well."""
    asked = i.events.where("event_type not in ('error', 'click')").select(F.col("event_id").alias("review_id"))
    return rv.delete_reviews(i.reviews, asked)[1].select("review_id", "claim_id", "review_action", "restored_review_status")


@register("review_history")
def review_history(i: Inputs):
    return rv.review_history(i.reviews, i.review_claims, i.review_checks, page=2, page_size=15).select("review_id", "claim_id", "check_id", "knowledge_base_id", "review_action", "position", "total")


@register("scope_by_permission")
def scope_by_permission(i: Inputs):
    asked = i.events.select("event_id", "user_id", F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("knowledge_base_id"))
    return sc.scope_by_permission(asked, i.grants, i.users)


@register("search_in_scope")
def search_in_scope(i: Inputs):
    q = i.queries.withColumn("user_id", F.substring("query_id", 2, 20).cast("bigint"))
    scoped = cut_lineage(sc.scoped_queries(q, i.grants))
    hits = search.search_fulltext(scoped.select(F.col("scope_id").alias("query_id"), "text", "knowledge_base_id"), i.corpus, 5)
    return sc.search_in_scope(scoped, hits, 5)


@register("resolve_object_kb")
def resolve_object_kb(i: Inputs):
    e = i.events
    kind = F.when(F.col("event_id") % 3 == 0, "document").when(F.col("event_id") % 3 == 1, "check").otherwise("claim")
    target = F.when(F.col("event_id") % 3 == 0, F.format_string("d%09d", "user_id")).otherwise(F.col("user_id").cast("string"))
    objects = e.select("event_id", kind.alias("kind"), target.alias("object_id"))
    return sc.resolve_object_kb(objects, i.docs, i.review_checks, i.review_claims)


# ------------------------------------------------------------------ J. evaluation
def gold(i: Inputs):
    """Benchmark passages with the documents that hold them literally."""
    b = i.table("benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), "text")
    d = i.table("documents").select(F.format_string("d%09d", "doc_id").alias("doc_uid"), F.col("text").alias("hay"))
    found = contains_join(b.withColumnRenamed("text", "needle"), d, needle="needle", hay="hay", needle_key="query_id", hay_keys=["doc_uid"])
    grouped = found.groupBy("query_id").agg(F.collect_set("doc_uid").alias("expected_doc_uids"))
    return cut_lineage(b.select("query_id").join(grouped, "query_id", "left").withColumn("expected_chunk_ids", F.array().cast("array<string>")))


def retrieval_cases(i: Inputs):
    hits = search.search_fulltext(i.queries.where("query_id LIKE 'b%'"), i.corpus, 10)
    return ev.eval_retrieval_cases(gold(i), hits, i.corpus.chunks)


@register("eval_retrieval_cases")
def eval_retrieval_cases(i: Inputs):
    return retrieval_cases(i)


@register("eval_retrieval_summary")
def eval_retrieval_summary(i: Inputs):
    return ev.eval_retrieval_summary(retrieval_cases(i))


def claim_cases(i: Inputs):
    l = i.table("labels")
    expected = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "verified").otherwise("needs_review")
    return l.select(F.col("doc_id").alias("case_id"), expected.alias("expected_verdict"))


def claim_rows(i: Inputs):
    d = i.table("documents")
    pick = lambda c: F.when(c % 3 == 0, "verified").when(c % 3 == 1, "needs_review").otherwise("rejected")
    one = d.select(F.col("doc_id").alias("case_id"), F.lit(1).alias("seq"), pick(F.col("n_chars")).alias("verdict"), (F.col("doc_id") % 4).alias("evidence_count"))
    two = d.where("doc_id % 3 = 1").select(F.col("doc_id").alias("case_id"), F.lit(2).alias("seq"), pick(F.length("lang") + F.col("doc_id")).alias("verdict"), (F.col("doc_id") % 2).alias("evidence_count"))
    return ev.eval_claim_results(claim_cases(i), one.unionByName(two).where("case_id % 11 <> 0"))


@register("eval_claim_results")
def eval_claim_results(i: Inputs):
    return claim_rows(i)


@register("eval_claim_summary")
def eval_claim_summary(i: Inputs):
    return ev.eval_claim_summary(claim_rows(i))


@register("eval_claim_run")
def eval_claim_run(i: Inputs):
    """All conversation turns as cases; every ninth conversation's have no text."""
    n = F.regexp_extract("check_id", r"c(\d+)-", 1).cast("int")
    cases = i.texts.select(F.col("check_id").alias("case_id"), F.when(n % 9 != 8, F.col("input_text")).alias("claim_text"), F.when(n % 2 == 0, "verified").otherwise("needs_review").alias("expected_verdict"))
    return ev.eval_claim_run(cases, checked(i).claims)


def suite(i: Inputs):
    v = verdicts(i)
    checks = cl.overall_verdict(v).join(cl.overall_risk(v), "check_id").join(cl.check_summary(v, rule_hits(i)).select("check_id", "claim_count"), "check_id")
    conv = F.regexp_extract("check_id", r"c(\d+)-", 1).cast("int")
    cases = i.texts.select(
        F.col("check_id").alias("case_id"), F.when(conv % 3 == 0, "passed").when(conv % 3 == 1, "rejected").alias("expected_overall_verdict"),
        F.when(conv % 2 == 0, "high").otherwise("").alias("expected_risk_level"), F.when(conv % 4 != 0, F.lit(1)).alias("expected_claim_count"),
    )
    return ev.eval_check_suite(cases, checks)


@register("eval_check_suite")
def eval_check_suite(i: Inputs):
    return suite(i)


@register("eval_check_totals")
def eval_check_totals(i: Inputs):
    return ev.eval_check_totals(suite(i))


@register("eval_failure_breakdown")
def eval_failure_breakdown(i: Inputs):
    return ev.eval_failure_breakdown(suite(i))


@register("describe_mismatch")
def describe_mismatch(i: Inputs):
    return ev.describe_mismatch(suite(i))


def alignment_cases(i: Inputs):
    q = i.queries
    number = F.substring("query_id", 2, 20).cast("bigint")
    short = q.where("query_id LIKE 'k%'").select(number.alias("case_id"), F.col("text").alias("query"))
    return short.join(i.table("benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("expected_evidence")), "case_id")


def alignments(i: Inputs):
    return cut_lineage(ev.suggest_alignments(alignment_cases(i), rp.evidence_catalog(i.corpus.chunks, i.corpus.docs, whole=True), 3))


@register("suggest_alignments")
def suggest_alignments(i: Inputs):
    return alignments(i)


@register("alignment_coverage")
def alignment_coverage(i: Inputs):
    return ev.alignment_coverage(alignment_cases(i), alignments(i))


@register("eval_report_rows")
def eval_report_rows(i: Inputs):
    return ev.eval_report_rows(ev.eval_retrieval_summary(retrieval_cases(i)), ev.eval_claim_summary(claim_rows(i)))


@register("align_report_rows")
def align_report_rows(i: Inputs):
    return ev.align_report_rows(alignment_cases(i), alignments(i), rp.evidence_catalog(i.corpus.chunks, i.corpus.docs))


# ------------------------------------------------------------------ K. streams
def table_stream(i: Inputs, name: str):
    return i.spark.readStream.schema(i.table(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(i.sf_dir)


def run_stream(i: Inputs, aggregated, name: str, key: str, order=()):
    folder = fresh_folder(i, name)
    ss.stream_to_folder(aggregated, folder, f"{folder}/checkpoint", [key]).awaitTermination()
    return ss.read_state(i.spark, folder, [key], order)


@register("stream_progress")
def stream_progress(i: Inputs):
    """Events as progress: user = document, type = stage, value = percent."""
    e = table_stream(i, "events").select(F.col("user_id").alias("doc_uid"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("value").alias("percent"))
    return run_stream(i, ss.progress_by_document(e), "progress", "doc_uid")


@register("overall_progress")
def overall_progress(i: Inputs):
    """The same progress over all documents."""
    e = i.events.select(F.col("user_id").alias("doc_uid"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("value").alias("percent"))
    return ss.overall_progress(ss.progress_by_document(e))


@register("stream_review_status")
def stream_review_status(i: Inputs):
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "approved").when(kind == "error", "rejected").otherwise("updated")
    e = table_stream(i, "events").where(kind.isin("purchase", "error", "click"))
    e = e.select(F.col("user_id").alias("claim_id"), F.col("event_id").alias("review_id"), action.alias("review_action"), F.col("ts").cast("timestamp").alias("created_at"))
    return run_stream(i, ss.review_status(e), "review", "claim_id", ["last"]).select("claim_id", "review_status")


@register("stream_ingest")
def stream_ingest(i: Inputs):
    """The documents table as a stream of Markdown files."""
    d = table_stream(i, "documents")
    files = d.select(
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.timestamp_seconds(F.lit(vi.EPOCH) + F.col("doc_id")).alias("modified"), F.expr(vi.MARKDOWN).alias("value")
    )
    folder = fresh_folder(i, "ingest")
    ss.stream_ingest(files, folder, f"{folder}/checkpoint").awaitTermination()
    version = ss.latest_version(i.spark, folder)
    chunks = i.spark.read.parquet(f"{folder}/chunks/version={version}").groupBy("doc_uid").agg(F.count(F.lit(1)).alias("chunk_count"))
    return i.spark.read.parquet(f"{folder}/docs/version={version}").select("doc_uid", "source_path", "source_hash").join(chunks, "doc_uid")


@register("stream_check")
def stream_check(i: Inputs):
    """The conversations arriving as a stream, each in its own knowledge base."""
    c = vi.as_texts(table_stream(i, "conversations")).drop("created_at")
    folder = fresh_folder(i, "checks")
    ss.stream_check(c, i.corpus, i.rules, folder, f"{folder}/checkpoint", tags="tags", lexicon=vi.LOGIC).awaitTermination()
    return sf.read_check_result(i.spark, folder, "claims").select("check_id", "claim_no", "verdict", "confidence", "risk_level", "evidence_count")


# ------------------------------------------------------------------ L. scorers
def toy_embedder(texts):
    """Length and number of e's; refuses batches over three texts."""
    if len(texts) > 3:
        raise RuntimeError("batch too large")
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@register("embed_with")
def embed_with(i: Inputs):
    made = pl.embed_with(i.corpus.chunks, toy_embedder)
    return made.select("chunk_id", F.get("embedding", F.lit(0)).alias("chars"), F.get("embedding", F.lit(1)).alias("es"))


@register("rerank_with")
def rerank_with(i: Inputs):
    """Longer contents first; queries whose text holds an x fail and keep their order."""

    def by_length(query, contents):
        if "x" in query:
            raise RuntimeError("refused")
        return [(n, float(len(c))) for n, c in enumerate(contents)]

    hits = search.search_fulltext(i.queries, i.corpus, 10)
    scores = pl.rerank_with(hits, i.queries, i.corpus.chunks, by_length)
    return rt.apply_rerank(hits, scores, 10).select("query_id", "rank", "chunk_id", "rerank_score")


@register("judge_with")
def judge_with(i: Inputs):
    """A judge that fails on long prompts, answers with text on some and with JSON else."""

    def judge(system, prompt):
        if len(prompt) % 5 == 0:
            raise RuntimeError("refused")
        if len(prompt) % 5 == 1:
            return "no idea"
        return 'Sure: {"verdict": "verified", "evidence_judgement": "support", "confidence": 0.9, "risk_level": "low", "reason": "ok"}'

    prompts = cl.build_prompts(i.claims, selected_texts(i), rule_hits(i), lexicon=vi.LOGIC)
    return pl.judge_with(prompts, verdicts(i), judge)
