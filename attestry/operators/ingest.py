"""Documents, change detection, upkeep of derived tables and knowledge bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import markdown as md
from attestry.functions import text as tx
from attestry.operators import normalize as nz


def doc_id_of(title: Column) -> Column:
    return F.replace(F.lower(title), F.lit(" "), F.lit("_"))


def doc_uid_of(doc_id: Column, edition: Column) -> Column:
    return F.concat_ws("_", doc_id, F.replace(F.coalesce(F.nullif(edition, F.lit("")), F.lit("default")), F.lit(" "), F.lit("_")))


def extract_metadata(files: DataFrame) -> DataFrame:
    """Title, doc_id and doc_uid from (path, content); the file stem is the fallback title."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rows = files.withColumn("doc_title", md.first_heading_title(F.col("content"), stem))
    doc_id = doc_id_of(F.col("doc_title"))
    return rows.select("path", "doc_title", doc_id.alias("doc_id"), doc_uid_of(doc_id, F.lit("default")).alias("doc_uid"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_uid", F.sha2("content", 256).alias("source_hash"))


def detect_changes(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """(source_path, change) with change new, skipped, moved, changed or missing.

    Both sides are (source_path, source_hash, knowledge_base_id).
    """
    i = incoming.select("source_path", F.col("source_hash").alias("i_hash"), F.col("knowledge_base_id").alias("i_kb"))
    s = stored.select("source_path", F.col("source_hash").alias("s_hash"), F.col("knowledge_base_id").alias("s_kb"))
    same = F.lit(not force) & (F.col("i_hash") == F.col("s_hash"))
    change = (
        F.when(F.col("i_hash").isNull(), "missing")
        .when(F.col("s_hash").isNull(), "new")
        .when(same & (F.col("i_kb") == F.col("s_kb")), "skipped")
        .when(same, "moved")
        .otherwise("changed")
    )
    return i.join(s, "source_path", "full_outer").select("source_path", change.alias("change"))


def reconcile_scan(scanned: DataFrame, registered: DataFrame) -> DataFrame:
    """Scanned files against registered documents, with a hint what to do.

    ``scanned`` is (source_path, size_bytes), ``registered`` (source_path, doc_uid, index_status).
    """
    joined = scanned.withColumn("on_disk", F.lit(True)).join(registered.withColumn("known", F.lit(True)), "source_path", "full_outer")
    known, on_disk = F.coalesce("known", F.lit(False)), F.coalesce("on_disk", F.lit(False))
    status = F.coalesce(F.nullif("index_status", F.lit("")), F.lit("not_registered"))
    rebuild = known & (status != "indexed")
    return joined.select(
        "source_path",
        known.alias("is_registered"),
        on_disk.alias("source_exists"),
        status.alias("index_status"),
        rebuild.alias("needs_rebuild"),
        F.when(rebuild, "建议重建").when(known, "已就绪").when(~on_disk, "源文件缺失").otherwise("可注册").alias("action_hint"),
    )


def scan_totals(reconciled: DataFrame) -> DataFrame:
    return reconciled.agg(
        F.count_if("source_exists").alias("total_files"),
        F.count_if("is_registered").alias("registered_files"),
        F.count_if(~F.col("is_registered") & F.col("source_exists")).alias("pending_register_files"),
        F.count_if("needs_rebuild").alias("needs_rebuild_files"),
    )


def upsert_documents(stored: DataFrame, incoming: DataFrame, key: str = "doc_uid") -> DataFrame:
    """Incoming rows replace stored ones of the same key; the first creation time stays.

    One shuffle on the key; a key repeated in the input keeps its latest row.
    """
    both = stored.withColumn("batch", F.lit(0)).unionByName(incoming.withColumn("batch", F.lit(1)))
    rest = [c for c in stored.columns if c not in (key, "created_at")]
    latest = both.groupBy(key).agg(
        F.min_by("created_at", F.struct("batch", "created_at")).alias("created_at"),
        F.max_by(F.struct(*rest), F.struct("batch", "updated_at")).alias("r"),
    )
    return latest.select(key, "created_at", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*stored.columns)


def replace_derived_rows(stored: DataFrame, changed: DataFrame, fresh: DataFrame, key: str = "doc_uid") -> DataFrame:
    """Rows of the changed documents taken out, their new rows put in."""
    return stored.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def rebuild_documents(docs: DataFrame, wanted: DataFrame, size: int = md.CHUNK_SIZE) -> dict[str, DataFrame]:
    """Derived tables of a set of documents, each on its own so either may be written alone."""
    from attestry.operators import retrieval, structure, vectors

    chosen = docs.join(wanted.select("doc_uid").distinct(), "doc_uid", "left_semi")
    chunks = structure.build_chunks(chosen, size)
    return {
        "sections": structure.parse_sections(chosen),
        "chunks": chunks,
        "word_sets": retrieval.chunk_word_sets(chunks),
        "vectors": vectors.embed_hash(chunks),
    }


def reassign_knowledge_base(docs: DataFrame, assignments: DataFrame) -> DataFrame:
    """Documents with the knowledge base of (doc_uid, new_kb) where one is given."""
    return (
        docs.join(assignments.select("doc_uid", "new_kb"), "doc_uid", "left")
        .withColumn("knowledge_base_id", F.coalesce("new_kb", "knowledge_base_id"))
        .drop("new_kb")
    )


def cascade_delete(tables: dict[str, DataFrame], links: list[tuple[str, str, str]], removed: DataFrame) -> dict[str, DataFrame]:
    """Tables without the removed root keys and everything that hangs on them.

    ``links`` lists (parent table, child table, key) from the root down; ``removed`` holds
    the root's keys.
    """
    root, _, root_key = links[0]
    gone = {root: tables[root].join(removed.select(root_key).distinct(), root_key, "left_semi")}
    left = {root: tables[root].join(removed.select(root_key).distinct(), root_key, "left_anti")}
    for parent, child, key in links:
        keys = gone[parent].select(key).distinct()
        gone[child] = tables[child].join(keys, key, "left_semi")
        left[child] = tables[child].join(keys, key, "left_anti")
    return left


def guard_kb_delete(bases: DataFrame, docs: DataFrame, checks: DataFrame, claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Dependent counts per knowledge base and whether it may be deleted."""
    kb = "knowledge_base_id"
    of_check = checks.select("check_id", kb)
    of_claim = claims.select("claim_id", "check_id").join(of_check, "check_id")
    of_review = reviews.select("claim_id").join(of_claim.select("claim_id", kb), "claim_id")
    rows = bases.select(kb, "is_default")
    for table, name in ((docs, "document_count"), (checks, "quality_check_count"), (of_claim, "claim_count"), (of_review, "review_count")):
        rows = rows.join(table.groupBy(kb).agg(F.count(F.lit(1)).alias(name)), kb, "left")
    rows = rows.na.fill(0, ["document_count", "quality_check_count", "claim_count", "review_count"])
    total = F.col("document_count") + F.col("quality_check_count") + F.col("claim_count") + F.col("review_count")
    return rows.withColumn("deletable", ~F.col("is_default") & (total == 0))


def set_default_kb(bases: DataFrame, upserts: DataFrame) -> DataFrame:
    """Knowledge bases after the upserts; the newest default among them is the only one."""
    merged = upsert_documents(bases, upserts, "knowledge_base_id")
    chosen = upserts.where("is_default").agg(F.max_by("knowledge_base_id", F.struct("updated_at", "knowledge_base_id"))).scalar()
    rows = merged.withColumn("chosen", chosen)
    return rows.withColumn(
        "is_default", F.when(F.col("chosen").isNull(), F.col("is_default")).otherwise(F.col("knowledge_base_id") == F.col("chosen"))
    ).drop("chosen")


def kb_listing(bases: DataFrame) -> DataFrame:
    """Default first, then newest, then by name."""
    return bases.orderBy(F.desc("is_default"), F.desc("updated_at"), "name")


def kb_lookup(requests: DataFrame, bases: DataFrame) -> DataFrame:
    """Each request's knowledge base; a request without one gets the default."""
    default = bases.where("is_default").agg(F.max("knowledge_base_id")).scalar()
    return requests.withColumn("knowledge_base_id", F.coalesce(F.nullif("knowledge_base_id", F.lit("")), default))


def kb_id(text: Column) -> Column:
    """Identifier from free text: other characters become one ``_``; null when nothing is left."""
    cleaned = F.regexp_replace(tx.strip(text), r"[^0-9A-Za-z_\-\u4e00-\u9fff]+", "_")
    return F.nullif(F.trim(F.regexp_replace(cleaned, "_+", "_"), F.lit("_")), F.lit(""))


def normalize_kb_id(rows: DataFrame, source: str = "name") -> DataFrame:
    cleaned = kb_id(F.col(source))
    return rows.withColumn("kb_id", cleaned).withColumn("valid", cleaned.isNotNull())


def backfill_columns(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns added with their default; a blank knowledge base becomes ``default``."""
    for name, value in defaults.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    return rows.withColumn(
        "knowledge_base_id", F.coalesce(F.nullif(F.trim("knowledge_base_id"), F.lit("")), F.lit("default"))
    )


def job_log(docs: DataFrame, stage: str = "ingest") -> DataFrame:
    """One log row per document of an ingest run, ready to be appended."""
    return docs.select(
        F.sha2(F.concat_ws(":", "doc_uid", F.lit(stage)), 256).alias("job_id"),
        "doc_uid",
        F.lit(stage).alias("stage"),
        F.col("ingest_status").alias("status"),
        F.col("updated_at").alias("finished_at"),
    )
