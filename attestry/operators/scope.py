"""Access scope: what a user may read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scope_by_permission(requests: DataFrame, grants: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (…, user_id, knowledge_base_id) whose knowledge base the user may read.

    ``users`` is (user_id, is_admin); an administrator may read everything.
    """
    flagged = requests.join(users.select("user_id", "is_admin"), "user_id")
    granted = grants.select("user_id", "knowledge_base_id").distinct().withColumn("granted", F.lit(True))
    return (
        flagged.join(granted, ["user_id", "knowledge_base_id"], "left")
        .where(F.col("is_admin") | F.col("granted"))
        .drop("is_admin", "granted")
    )


def scoped_queries(queries: DataFrame, grants: DataFrame) -> DataFrame:
    """One query row per knowledge base its user may read; ``scope_id`` names the pair."""
    rows = queries.join(grants.select("user_id", "knowledge_base_id").distinct(), "user_id")
    return rows.withColumn("scope_id", F.concat_ws("|", F.col("query_id").cast("string"), "knowledge_base_id"))


def search_in_scope(scoped: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """First k distinct chunks per query over its knowledge bases in ascending order.

    ``scoped`` comes from ``scoped_queries``; ``hits`` are per ``scope_id``, at most k each.
    """
    rows = hits.withColumnRenamed("query_id", "scope_id").join(scoped.select("scope_id", "query_id", "knowledge_base_id"), "scope_id")
    first = rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct("knowledge_base_id", "rank", "doc_uid")).alias("m"))
    order = Window.partitionBy("query_id").orderBy("m.knowledge_base_id", "m.rank")
    return (
        first.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
        .select("query_id", F.col("position").alias("rank"), "chunk_id", F.col("m.doc_uid").alias("doc_uid"), F.col("m.knowledge_base_id").alias("knowledge_base_id"))
    )


def resolve_object_kb(objects: DataFrame, docs: DataFrame, checks: DataFrame, claims: DataFrame) -> DataFrame:
    """Knowledge base of (kind, object_id) rows of kind document, check or claim."""
    owner = (
        docs.select(F.lit("document").alias("kind"), F.col("doc_uid").cast("string").alias("object_id"), "knowledge_base_id")
        .unionByName(checks.select(F.lit("check").alias("kind"), F.col("check_id").cast("string").alias("object_id"), "knowledge_base_id"))
        .unionByName(
            claims.join(checks.select("check_id", "knowledge_base_id"), "check_id").select(
                F.lit("claim").alias("kind"), F.col("claim_id").cast("string").alias("object_id"), "knowledge_base_id"
            )
        )
    )
    return objects.join(owner, ["kind", "object_id"], "left")
