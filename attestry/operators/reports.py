"""Corpus metrics, document quality and listings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry import lexicons as lx
from attestry.lexicons import Thresholds
from attestry.operators.paging import Order, numbered_page, page_after, page_ends, sort_columns


def document_metrics(docs: DataFrame, sections: DataFrame, chunks: DataFrame, word_sets: DataFrame) -> DataFrame:
    """Sections, chunks, indexed chunks and chunk lengths per document."""
    s = sections.groupBy("doc_uid").agg(F.count(F.lit(1)).alias("section_count"))
    c = chunks.groupBy("doc_uid").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.min("token_count").alias("min_chunk_chars"),
        F.max("token_count").alias("max_chunk_chars"),
        F.sum("token_count").alias("total_chunk_chars"),
    )
    w = word_sets.groupBy("doc_uid").agg(F.count(F.lit(1)).alias("fts_chunk_count"))
    rows = docs.select("doc_uid").join(s, "doc_uid", "left").join(c, "doc_uid", "left").join(w, "doc_uid", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 1), F.lit(0.0))
    return rows.withColumn("avg_chunk_chars", ratio("total_chunk_chars", "chunk_count")).withColumn(
        "avg_chunks_per_section", ratio("chunk_count", "section_count")
    )


def sample_rows(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Evenly spaced rows per group, first and last included.

    ``order`` must number the rows of a group from 0 without gaps, so which positions are
    kept follows from the group's size and no group is sorted.
    """
    if n <= 0:
        return rows.limit(0)
    total = rows.groupBy(group).agg(F.max(order).alias("last_index"))
    spots = F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * F.col("last_index") / F.lit(max(n - 1, 1)), 0).cast("int")
        )
    )
    keep = F.when(F.col("last_index") < n, F.sequence(F.lit(0), F.col("last_index"))).otherwise(spots)
    wanted = total.select(group, F.explode(keep).alias(order))
    return rows.join(wanted, [group, order], "left_semi")


def document_quality(docs: DataFrame, metrics: DataFrame, vectors: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Checks of a stored document: issue texts and the level they add up to.

    ``docs`` is (doc_uid, ingest_status, index_status).
    """
    v = vectors.groupBy("doc_uid").agg(F.count(F.lit(1)).alias("vector_chunk_count"))
    rows = docs.select("doc_uid", "ingest_status", "index_status").join(metrics, "doc_uid").join(v, "doc_uid", "left").na.fill(0, ["vector_chunk_count"])
    text = lambda *parts: F.concat(*[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])
    danger = [
        F.when(F.col("ingest_status") != "completed", text("当前入库状态为 ", "$ingest_status")),
        F.when(F.col("section_count") == 0, F.lit("未解析出任何章节。")),
        F.when(F.col("chunk_count") == 0, F.lit("未生成任何分块。")),
    ]
    warning = [
        F.when(
            F.col("fts_chunk_count") != F.col("chunk_count"),
            text("全文索引条数 ", "$fts_chunk_count", " 与分块数 ", "$chunk_count", " 不一致。"),
        ),
        F.when(
            F.col("vector_chunk_count") != F.col("chunk_count"),
            text("向量索引条数 ", "$vector_chunk_count", " 与分块数 ", "$chunk_count", " 不一致。"),
        ),
        F.when(F.col("index_status") != "indexed", text("当前索引状态为 ", "$index_status", "，建议执行重建。")),
        F.when(
            (F.col("section_count") < limits.min_sections_for_long_doc)
            & (F.col("total_chunk_chars") >= limits.long_document_char_threshold),
            F.lit("章节数偏少，长文档可能没有按标题切开。"),
        ),
        F.when(F.col("avg_chunks_per_section") >= limits.max_avg_chunks_per_section, F.lit("平均每章分块数偏高，可能切得过碎。")),
        F.when(F.col("max_chunk_chars") >= limits.max_chunk_chars, F.lit("存在超长分块，建议抽样检查分块边界。")),
        F.when(
            (F.col("min_chunk_chars") > 0)
            & (F.col("min_chunk_chars") <= limits.short_chunk_chars)
            & (F.col("chunk_count") >= limits.short_chunk_warn_min_chunk_count),
            F.lit("存在过短分块，可能影响检索效果。"),
        ),
    ]
    rows = rows.withColumn("danger", F.array_compact(F.array(*danger))).withColumn("warning", F.array_compact(F.array(*warning)))
    level = F.when(F.size("danger") > 0, "danger").when(F.size("warning") > 0, "warning").otherwise("success")
    return rows.select(
        *[c for c in rows.columns if c not in ("danger", "warning")],
        F.concat("danger", "warning").alias("issues"),
        level.alias("quality_level"),
        F.when(level == "success", "入库结构与索引看起来正常。")
        .otherwise("发现需要复核的问题，请结合抽样结果进一步检查。")
        .alias("quality_message"),
    )


def quality_thresholds(values: Mapping[str, object] | None = None) -> Thresholds:
    """Checked thresholds; an empty value takes the default, a bad one raises."""
    found = {}
    for name, (default, minimum) in lx.QUALITY_THRESHOLDS.items():
        value = (values or {}).get(name)
        try:
            found[name] = default if value in (None, "") else int(float(value))
        except (TypeError, ValueError) as exc:
            raise ValueError(f"{name} must be an integer") from exc
        if found[name] < minimum:
            raise ValueError(f"{name} must be at least {minimum}")
    if found["max_chunk_chars"] <= found["short_chunk_chars"]:
        raise ValueError("max_chunk_chars must exceed short_chunk_chars")
    return Thresholds(**found)


def threshold_rows(settings: DataFrame) -> DataFrame:
    """The same over a table of settings: (setting_id, name, value) → checked values.

    ``problem`` names what is wrong with a value and is null when it is usable.
    """
    spark = settings.sparkSession
    known = spark.createDataFrame(
        [(n, d, m) for n, (d, m) in lx.QUALITY_THRESHOLDS.items()], "name string, default_value int, minimum int"
    )
    number = F.col("value").try_cast("double").cast("int")
    blank = F.coalesce("value", F.lit("")) == ""
    rows = settings.join(F.broadcast(known), "name")
    resolved = F.when(blank, F.col("default_value")).otherwise(number)
    return rows.select(
        "setting_id",
        "name",
        resolved.alias("resolved"),
        F.when(resolved.isNull(), "not an integer").when(resolved < F.col("minimum"), "below minimum").alias("problem"),
    )


def document_quality_batch(quality: DataFrame) -> DataFrame:
    n = lambda level: F.count_if(F.col("quality_level") == level)
    return quality.agg(
        F.count(F.lit(1)).alias("document_count"),
        n("success").alias("success_count"),
        n("warning").alias("warning_count"),
        n("danger").alias("danger_count"),
    )


SUMMARY_COUNTS = (
    "document_count", "completed_document_count", "indexed_document_count", "rebuild_pending_document_count",
    "failed_document_count", "section_count", "chunk_count", "quality_check_count", "claim_count", "review_count",
)


def database_summary(docs: DataFrame, sections: DataFrame, chunks: DataFrame, checks: DataFrame, claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Ten counts per knowledge base and, with a null knowledge base, over all.

    Every table is counted once by knowledge base; the totals come from rolling up those
    few rows.
    """
    kb = "knowledge_base_id"
    counted = docs.groupBy(kb).agg(
        F.count(F.lit(1)).alias("document_count"),
        F.count_if(F.col("ingest_status") == "completed").alias("completed_document_count"),
        F.count_if(F.col("index_status") == "indexed").alias("indexed_document_count"),
        F.count_if(F.col("index_status").isin("pending", "rebuilding")).alias("rebuild_pending_document_count"),
        F.count_if((F.col("index_status") == "partial_failed") | (F.col("ingest_status") == "failed")).alias("failed_document_count"),
    )
    of_claim = claims.select("claim_id", "check_id").join(checks.select("check_id", kb), "check_id")
    of_review = reviews.select("claim_id").join(of_claim.select("claim_id", kb), "claim_id")
    parts = ((sections, "section_count"), (chunks, "chunk_count"), (checks, "quality_check_count"), (of_claim, "claim_count"), (of_review, "review_count"))
    for table, name in parts:
        counted = counted.join(table.groupBy(kb).agg(F.count(F.lit(1)).alias(name)), kb, "full_outer")
    counted = counted.na.fill(0, list(SUMMARY_COUNTS))
    return counted.rollup(kb).agg(*[F.sum(c).alias(c) for c in SUMMARY_COUNTS])


#: Documents are listed newest first.
NEWEST_DOCUMENTS = (("updated_at", "desc"), ("doc_uid", "asc"))


def list_documents(
    docs: DataFrame, *, doc_uid=None, knowledge_base_id=None, status=None, page: int = 1, page_size: int = 20, after: Mapping | None = None, ends: DataFrame | None = None
) -> DataFrame:
    """A page of documents, newest first, with the total number matching.

    ``after`` (updated_at and doc_uid of the last row shown) gives the next page, whatever ``page``; a page by number
    begins at the key that ``ends`` (``page_ends`` of the same rows, made here if missing) holds for it.
    """
    rows = docs
    if doc_uid:
        rows = rows.where(F.col("doc_uid") == doc_uid)
    if knowledge_base_id:
        rows = rows.where(F.col("knowledge_base_id") == knowledge_base_id)
    if status:
        rows = rows.where(F.col("ingest_status") == status)
    total = rows.agg(F.count(F.lit(1))).scalar()
    picked = page_after(rows, NEWEST_DOCUMENTS, after, page_size) if after is not None else numbered_page(rows, NEWEST_DOCUMENTS, page, page_size, ends)
    return picked.withColumn("total", total)


def recent_checks(checks: DataFrame, claims: DataFrame, limit: int = 10) -> DataFrame:
    """Newest checks per knowledge base with their claims nested and the pending count."""
    order = Window.partitionBy("knowledge_base_id").orderBy(F.desc("created_at"), F.desc("check_id"))
    recent = checks.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    pending = F.lower(F.coalesce("review_status", F.lit("pending"))) == "pending"
    nested = (
        claims.join(recent.select("check_id"), "check_id", "left_semi")
        .groupBy("check_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("claim_no", "claim_id", "claim_text", "verdict", "risk_level", "review_status"))).alias("claims"),
            F.count_if(pending).alias("pending_claim_count"),
        )
    )
    return recent.join(nested, "check_id", "left").na.fill({"pending_claim_count": 0})


def recent_claims(recent: DataFrame) -> DataFrame:
    """Nested claims of recent checks as rows with their check's columns."""
    return recent.select("check_id", "knowledge_base_id", F.col("created_at").alias("check_created_at"), F.explode("claims").alias("c")).select(
        "check_id", "knowledge_base_id", "check_created_at", "c.*"
    )


DETAIL_FIELDS = (
    "chunk_id", "doc_uid", "doc_title", "source_span", "retrieval_source", "matched_sources", "matched_queries", "rerank_score",
    "context_mode", "section_title", "evidence_relation", "relation_reason", "content_preview",
)


def claim_detail(claims: DataFrame) -> DataFrame:
    """Claims with an evidence array; an empty one gets a stand-in from the source columns."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    history = F.array(F.lit("history"))
    stand_in = F.struct(
        F.coalesce(F.nullif("source_span", F.lit("")), "claim_id").alias("chunk_id"),
        blank("source_doc").alias("doc_uid"),
        blank("source_doc").alias("doc_title"),
        blank("source_span").alias("source_span"),
        F.lit("history").alias("retrieval_source"),
        history.alias("matched_sources"),
        history.alias("matched_queries"),
        F.lit(None).cast("double").alias("rerank_score"),
        F.lit("history_record").alias("context_mode"),
        F.lit("").alias("section_title"),
        F.coalesce("evidence_judgement", F.lit("insufficient")).alias("evidence_relation"),
        blank("evidence_reason").alias("relation_reason"),
        F.coalesce(F.nullif("evidence", F.lit("")), "claim_text").alias("content_preview"),
    )
    empty = F.coalesce(F.size("evidence_details"), F.lit(0)) <= 0
    has_source = (blank("source_doc") != "") | (blank("source_span") != "") | (blank("evidence") != "")
    return claims.withColumn(
        "evidence_details",
        F.when(empty & has_source, F.array(stand_in)).when(empty, F.array().cast(claims.schema["evidence_details"].dataType)).otherwise(F.col("evidence_details")),
    )


def get_check_result(checks: DataFrame, claims: DataFrame, rule_hits: DataFrame) -> DataFrame:
    """Checks with their claims and rule hits nested."""
    c = claims.groupBy("check_id").agg(F.array_sort(F.collect_list(F.struct("claim_no", "claim_id", "claim_text", "verdict"))).alias("claims"))
    h = rule_hits.groupBy("check_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "rule_no", "rule_code", "hit_level"))).alias("rule_hits"))
    return checks.join(c, "check_id", "left").join(h, "check_id", "left")


def evidence_catalog(chunks: DataFrame, docs: DataFrame, *, knowledge_base_id: str | None = None, query: str = "", limit: int | None = None, excerpt: int = 160, whole: bool = False) -> DataFrame:
    """Chunks with document columns and an excerpt to show; ``whole`` adds the content, ``limit`` takes the first
    rows in (title, index) order."""
    rows = chunks.drop("doc_title", "knowledge_base_id").join(docs.select("doc_uid", "knowledge_base_id", "doc_title", "source_name"), "doc_uid")
    if knowledge_base_id:
        rows = rows.where(F.col("knowledge_base_id") == knowledge_base_id)
    if query.strip():
        rows = rows.where(F.contains(F.lower("content"), F.lit(query.strip().lower())))
    anchor = F.coalesce(
        F.nullif(F.trim("source_anchor"), F.lit("")),
        F.concat(F.lit("L"), F.col("source_start_line").cast("string"), F.lit("-L"), F.col("source_end_line").cast("string")),
    )
    picked = rows.select(
        "knowledge_base_id", "doc_uid", "doc_title", "source_name", "chunk_id", "chunk_index", "heading_path",
        "source_start_line", "source_end_line", anchor.alias("source_anchor"), "chunk_type",
        F.substring("content", 1, excerpt).alias("content_excerpt"),
        *(["content"] if whole else []),
    )
    return picked if limit is None else picked.orderBy("doc_title", "chunk_index", "chunk_id").limit(max(int(limit), 1))


def paginate(rows: DataFrame, order: Order, page: int = 1, page_size: int = 20, ends: DataFrame | None = None) -> DataFrame:
    """One page with running numbers; the page number is held inside the valid range, an empty table has one page.

    ``ends`` is ``page_ends`` of the same rows, made here if missing. The page begins after the key the page before
    ends with, so no rows are skipped or counted on the way to a deep page.
    """
    ends = page_ends(rows, order, page_size) if ends is None else ends
    pages = ends.agg(F.max("page")).first()[0] or 1
    page = max(1, min(int(page or 1), pages))
    picked = numbered_page(rows, order, page, page_size, ends)
    row_no = F.row_number().over(Window.orderBy(*sort_columns(order))) + (page - 1) * page_size
    return picked.withColumn("row_no", row_no).withColumn("page", F.lit(page)).withColumn("pages", F.lit(pages).cast("int"))
