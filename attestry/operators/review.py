"""Human review: submissions, current status, queue and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.lexicons import REVIEW_ACTIONS
from attestry.operators.paging import beyond, sort_columns


def submit_reviews(submitted: DataFrame, claims: DataFrame) -> DataFrame:
    """Reviews with a known action on an existing claim; the rows to append."""
    return submitted.where(F.col("review_action").isin(*REVIEW_ACTIONS)).join(claims.select("claim_id"), "claim_id", "left_semi")


def latest_review_status(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """(claim_id, review_status, reviewed_at): the newest review by time, then id, else pending.

    The aggregate combines on the map side, so a claim with very many reviews is no burden.
    Leaving out a deleted review gives the status to fall back to.
    """
    newest = reviews.groupBy("claim_id").agg(
        F.max_by("review_action", F.struct("created_at", "review_id")).alias("review_status"), F.max("created_at").alias("reviewed_at")
    )
    return claims.select("claim_id").join(newest, "claim_id", "left").na.fill({"review_status": "pending"})


def delete_reviews(reviews: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews without the requested ones, and the deleted ones with the status their claim falls back to.

    ``requests`` is (review_id); unknown ids delete nothing.  The status is that of the claim's newest
    review that is left, else pending.
    """
    wanted = requests.select("review_id").distinct()
    left = reviews.join(wanted, "review_id", "left_anti")
    gone = reviews.join(wanted, "review_id", "left_semi")
    newest = left.groupBy("claim_id").agg(F.max_by("review_action", F.struct("created_at", "review_id")).alias("restored_review_status"))
    return left, gone.join(newest, "claim_id", "left").na.fill({"restored_review_status": "pending"})


def review_queue(claims: DataFrame, checks: DataFrame, limit: int | None = 50) -> DataFrame:
    """Claims with their check; pending first, then the latest update."""
    c = checks.select("check_id", "knowledge_base_id", F.col("created_at").alias("check_created_at"))
    rows = claims.join(c, "check_id")
    pending = F.coalesce("review_status", F.lit("pending")) == "pending"
    order = [
        F.when(pending, 0).otherwise(1).asc(),
        F.coalesce("updated_at", "created_at", "check_created_at").desc(),
        F.col("check_created_at").desc(),
        F.col("created_at").desc(),
        F.col("claim_id").asc(),
    ]
    return rows.orderBy(*order) if limit is None else rows.orderBy(*order).limit(limit)


def filter_review_queue(queue: DataFrame, scope: str = "all", risk: str = "all") -> DataFrame:
    """Queue rows of a scope (``pending``, ``processed``, ``all``) and risk, with their side."""
    pending = F.lower(F.coalesce("review_status", F.lit("pending"))) == "pending"
    rows = queue.withColumn("side", F.when(pending, "pending").otherwise("processed"))
    if scope in ("pending", "processed"):
        rows = rows.where(F.col("side") == scope)
    if risk in ("high", "medium", "low"):
        rows = rows.where(F.lower("risk_level") == risk)
    return rows


#: Reviews are listed newest first.
NEWEST_REVIEWS = (("created_at", "desc"), ("review_id", "desc"))


def review_history(reviews: DataFrame, claims: DataFrame, checks: DataFrame, page: int = 1, page_size: int = 20, after: DataFrame | None = None) -> DataFrame:
    """A page of reviews per knowledge base, newest first, with the total.

    ``after`` holds rows of the page before: every knowledge base goes on after its last one there, and one without
    rows has no further page. Only ``page_size`` rows a knowledge base then leave a partition, however deep the page.
    """
    rows = reviews.join(claims.select("claim_id", "check_id", "claim_text"), "claim_id").join(
        checks.select("check_id", "knowledge_base_id"), "check_id"
    )
    order = Window.partitionBy("knowledge_base_id").orderBy(*sort_columns(NEWEST_REVIEWS))
    totals = rows.groupBy("knowledge_base_id").agg(F.count(F.lit(1)).alias("total"))
    if after is not None:
        last = after.groupBy("knowledge_base_id").agg(F.max(F.struct("position", "created_at", "review_id")).alias("last"))
        key = {c: F.col(f"last.{c}") for c, _ in NEWEST_REVIEWS}
        following = rows.join(last, "knowledge_base_id").where(beyond(NEWEST_REVIEWS, key)).withColumn("step", F.row_number().over(order))
        following = following.where(F.col("step") <= page_size).withColumn("position", (F.col("last.position") + F.col("step")).cast("int"))
        return following.drop("step", "last").join(totals, "knowledge_base_id")
    first = max(page - 1, 0) * page_size
    top = rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= first + page_size)
    return top.where(F.col("position") > first).join(totals, "knowledge_base_id")
