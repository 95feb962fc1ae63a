"""Structured Streaming forms: ingest, progress, review status, checking."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestry.functions.session import cut_lineage
from attestry.operators.ingest import detect_changes, replace_derived_rows, upsert_documents
from attestry.operators.structure import build_chunks
from attestry.plans.check import run_check
from attestry.plans.corpus import Corpus
from attestry.sources.files import documents_from_text, write_check_result


def _present(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; a store that can't be asked is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _versions(spark: SparkSession, folder: str) -> list:
    """Committed versions (version, stream, batch), oldest first."""
    if not _present(spark, f"{folder}/versions"):
        return []
    return sorted(spark.read.schema("version int, stream string, batch long").parquet(f"{folder}/versions").collect())


def latest_version(spark: SparkSession, folder: str) -> int:
    """Newest committed version of the stored tables; -1 when there is none."""
    return max((v.version for v in _versions(spark, folder)), default=-1)


def _commit(spark: SparkSession, folder: str, version: int, stream: str, batch: int) -> None:
    marker = spark.createDataFrame([(version, stream, batch)], "version int, stream string, batch long")
    marker.coalesce(1).write.mode("append").parquet(f"{folder}/versions")


def ingest_batch(batch: DataFrame, folder: str, number: int, stream: str = "default") -> None:
    """One batch of (path, value) files merged into the stored documents and chunks.

    A batch is known by its stream and number: sent again it changes nothing, while batch 0 of a stream that
    starts anew over an existing store is a batch like others.  Unchanged content is skipped before it is
    parsed; changed documents replace theirs.  Tables are written under a new version that counts only once
    its marker is there, so a batch run again after a failure gives the same tables.
    """
    spark = batch.sparkSession
    committed = _versions(spark, folder)
    if any((v.stream, v.batch) == (stream, number) for v in committed):
        return
    before = max((v.version for v in committed), default=-1)
    version = before + 1
    versionless = batch.withColumn("path", F.regexp_replace("path", r"@[0-9]+(\.[A-Za-z]+)$", "$1"))
    newest = versionless.groupBy("path").agg(F.max_by("value", "modified").alias("value"), F.max("modified").alias("modified"))
    incoming = documents_from_text(newest).join(newest.select(F.col("path").alias("source_path"), "modified"), "source_path")
    incoming = incoming.withColumn("created_at", F.col("modified")).withColumn("updated_at", F.col("modified")).drop("modified")
    stored = incoming.limit(0) if before < 0 else spark.read.parquet(f"{folder}/docs/version={before}")
    change = detect_changes(incoming, stored).where(F.col("change").isin("new", "changed", "moved"))
    fresh = incoming.join(change.select("source_path"), "source_path", "left_semi")
    docs = cut_lineage(upsert_documents(stored, fresh.select(*stored.columns)))
    # Two files may share a doc_uid; only the one that was kept is cut into chunks.
    kept = docs.join(fresh.select("doc_uid", "source_path"), ["doc_uid", "source_path"], "left_semi")
    made = build_chunks(kept)
    if before >= 0:
        old = spark.read.parquet(f"{folder}/chunks/version={before}")
        made = replace_derived_rows(old, kept, made.select(*old.columns))
    docs.write.mode("overwrite").parquet(f"{folder}/docs/version={version}")
    made.write.mode("overwrite").parquet(f"{folder}/chunks/version={version}")
    _commit(spark, folder, version, stream, number)


def landing_files(spark: SparkSession, landing: str) -> DataFrame:
    """Stream of (path, modified, value) for files below a landing folder.

    A new version of a file lands under a new name ``stem@N.ext``.
    """
    return (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{md,json}")
        .schema("value string")
        .load(landing)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    )


def stream_ingest(files: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Take in a stream of (path, modified, value) files and keep the tables up to date."""
    return (
        files.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, folder, int(number), checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def progress_by_document(events: DataFrame) -> DataFrame:
    """Latest stage and percent per document from (doc_uid, seq, stage, percent) events."""
    newest = events.groupBy("doc_uid").agg(F.max_by(F.struct("stage", "percent"), "seq").alias("s"))
    return newest.select("doc_uid", "s.stage", "s.percent")


def overall_progress(by_document: DataFrame) -> DataFrame:
    return by_document.agg(F.count(F.lit(1)).alias("document_count"), F.round(F.avg("percent"), 2).alias("overall_percent"))


def review_status(events: DataFrame) -> DataFrame:
    """Current status per claim; a late older event never wins, whatever the order of arrival."""
    key = F.struct("created_at", "review_id")
    return events.groupBy("claim_id").agg(F.max_by("review_action", key).alias("review_status"), F.max(key).alias("last"))


def stream_name(checkpoint: str) -> str:
    """A short name of a stream, which is what its checkpoint folder is."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:12]


def stream_to_folder(aggregated: DataFrame, folder: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Run an aggregation over a stream and keep its current state as a table in a folder.

    Only the groups that a batch changes leave the stream (update mode); they are one folder, named by the order of
    its making, the stream and the batch, that counts once Spark's marker is in it. A batch that is sent again finds
    its folder or writes it anew, and a stream that starts anew over an existing table goes on after what is there:
    its rows win over older ones of the same ``keys``.
    """
    spark, stream = aggregated.sparkSession, stream_name(checkpoint)

    def keep(changed: DataFrame, number: int) -> None:
        found = _state_folders(spark, folder)
        if any((s, b) == (stream, number) for _, s, b, _ in found):
            return
        place = max((p for p, _, _, _ in found), default=-1) + 1
        changed.select(*keys, *[c for c in changed.columns if c not in keys]).write.mode("overwrite").parquet(f"{folder}/state/{place:012d}-{stream}-{number}")

    return (
        aggregated.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _state_folders(spark: SparkSession, folder: str) -> list[tuple[int, str, int, str]]:
    """Whole folders of changes, oldest first: place, stream, batch, path."""
    if not _present(spark, f"{folder}/state"):
        return []
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [p for p in (s.getPath() for s in files.listStatus(top)) if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    named = [(p.getName().split("-"), p.toString()) for p in whole]
    return sorted((int(place), stream, int(batch), path) for (place, stream, batch), path in named)


def read_state(spark: SparkSession, folder: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The state that ``stream_to_folder`` has written: of each key the row that is last by ``order``, then by the time of writing."""
    found = _state_folders(spark, folder)
    if not found:
        raise FileNotFoundError(f"no state in {folder}")
    rows = spark.read.parquet(*[path for _, _, _, path in found]).withColumn("_place", F.regexp_extract(F.input_file_name(), r"/state/(\d{12})-", 1))
    rest = [c for c in rows.columns if c not in (*keys, "_place")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "_place")).alias("s"))
    return newest.select(*keys, "s.*")


def compact_state(spark: SparkSession, folder: str, keys: Sequence[str], order: Sequence[str] = ()) -> None:
    """Make one folder of all changes so far and remove those that it replaces; a reader finds either."""
    found = _state_folders(spark, folder)
    if len(found) < 2:
        return
    place, stream, batch, _ = found[-1]
    cut_lineage(read_state(spark, folder, keys, order)).write.mode("overwrite").parquet(f"{folder}/state/{place + 1:012d}-{stream}-{batch}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for _, s, b, path in found:
        # The last folder of every stream stays, so that its batches are known when they are sent again.
        if (s, b) != (stream, batch) and b == max(n for _, t, n, _ in found if t == s):
            continue
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def stream_check(
    texts: DataFrame, corpus: Corpus, rules: DataFrame, folder: str, checkpoint: str, **options
) -> StreamingQuery:
    """Check texts (check_id, input_text, …) as they arrive; each batch is one stored run, named by stream and batch."""
    stream = stream_name(checkpoint)

    def check(batch: DataFrame, batch_id: int) -> None:
        result = run_check(batch, corpus, rules, **options)
        write_check_result(result.checks, result.claims, result.rule_hits, folder, f"batch-{stream}-{batch_id}")

    return texts.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
