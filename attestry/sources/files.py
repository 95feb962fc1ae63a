"""Files in and out: scanning, Markdown and JSON documents, cases, rules, CSV."""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.functions.session import cut_lineage, small
from attestry.lexicons import TermDictionary
from attestry.operators.ingest import doc_id_of, doc_uid_of
from attestry.functions.markdown import first_heading_title

# Bytes of text that one file is given, about.
FILE_BYTES = 256 << 20
JSON_DOCUMENT = "title string, content string, edition string, author string, source string, source_name string, tags string"


def _below(path: Column, root: str) -> Column:
    """Directory right below the root a file lies in; ``default`` for files at the root."""
    rest = F.regexp_replace(path, "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    return F.coalesce(F.nullif(F.regexp_extract(rest, "^([^/]+)/", 1), F.lit("")), F.lit("default"))


def write_texts(docs: DataFrame, root: str, most: int = FILE_BYTES) -> None:
    """Texts as files, a folder per knowledge base with one file for every ``most`` bytes.

    Files are dealt to eight times as many partitions, so few share a task, and a task reads a bounded amount
    however large a knowledge base is.
    """
    size = F.ceil(F.sum(F.coalesce(F.octet_length("content"), F.lit(0)) + 1) / F.lit(most))
    files = docs.groupBy("knowledge_base_id").agg(F.greatest(size, F.lit(1)).cast("int").alias("files"))
    files = cut_lineage(files.withColumnRenamed("knowledge_base_id", "of"))
    total = files.agg(F.coalesce(F.sum("files"), F.lit(1))).first()[0]
    held = docs.join(small(files), F.col("knowledge_base_id").eqNullSafe(F.col("of")))
    held = held.withColumn("file", F.pmod(F.xxhash64("doc_uid"), F.col("files"))).select("knowledge_base_id", "file", "content")
    held.repartition(8 * int(total), "knowledge_base_id", "file").select("knowledge_base_id", "content").write.partitionBy("knowledge_base_id").text(root)


def scan_documents(spark: SparkSession, root: str, types: str = "md,MD,json,JSON") -> DataFrame:
    """(knowledge_base_id, path, file_type, size_bytes) of Markdown and JSON files below a root.

    File contents are not read: only the metadata columns of the file source are used.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{types}}}").load(root)
    )
    return files.select(
        _below(F.col("path"), root).alias("knowledge_base_id"),
        "path",
        F.lower(F.element_at(F.split("path", r"\."), -1)).alias("file_type"),
        F.col("length").alias("size_bytes"),
    )


def json_document(text: Column) -> Column:
    """Struct of a JSON document's fields; tags may be text or an array."""
    return F.from_json(text, JSON_DOCUMENT)


def tag_list(tags: Column) -> Column:
    parsed = F.from_json(tags, "array<string>")
    plain = F.split(tags, "[,，]")
    values = F.when(F.startswith(F.ltrim(tags), F.lit("[")), parsed).otherwise(plain)
    return tx.non_empty(F.transform(F.coalesce(values, F.array().cast("array<string>")), tx.strip))


def documents_from_text(files: DataFrame, root: str = "") -> DataFrame:
    """Document rows from (path, value) with the whole file text as value.

    A JSON object becomes ``# title`` and its content; a JSON file that holds no object is
    kept apart with ``ingest_status`` failed.
    """
    is_json = F.endswith(F.lower("path"), F.lit(".json"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rows = files.withColumn("j", F.when(is_json, json_document(F.col("value")))).withColumn("stem", stem)
    broken = is_json & (F.coalesce(F.schema_of_variant(F.try_parse_json("value")), F.lit("")).startswith("OBJECT") == F.lit(False))
    title = F.when(is_json, F.coalesce("j.title", "stem")).otherwise(first_heading_title(F.col("value"), F.col("stem")))
    content = F.when(is_json, F.concat(F.lit("# "), title, F.lit("\n\n"), F.coalesce("j.content", F.lit("")))).otherwise(F.col("value"))
    rows = rows.withColumn("doc_title", title).withColumn("broken", broken)
    doc_id = doc_id_of(F.col("doc_title"))
    return rows.select(
        doc_uid_of(doc_id, F.col("j.edition")).alias("doc_uid"),
        (_below(F.col("path"), root) if root else F.lit("default")).alias("knowledge_base_id"),
        doc_id.alias("doc_id"),
        "doc_title",
        F.col("j.edition").alias("edition"),
        F.col("j.author").alias("author"),
        F.coalesce("j.source", "j.source_name").alias("source_name"),
        tag_list(F.coalesce("j.tags", F.lit(""))).alias("tags"),
        F.col("path").alias("source_path"),
        F.sha2(content, 256).alias("source_hash"),
        content.alias("content"),
        F.when(F.col("broken"), "failed").otherwise("completed").alias("ingest_status"),
    )


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Whole Markdown and JSON files below a root as document rows."""
    files = (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{md,MD,json,JSON}")
        .text(root)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    return documents_from_text(files, root)


CASE_SCHEMA = (
    "case_id string, query string, claim_text string, input_text string, expected_verdict string, expected_evidence string, "
    "expected_doc_uids array<string>, expected_chunk_ids array<string>, expected_overall_verdict string, "
    "expected_risk_level string, expected_claim_count int"
)


def cases_from_lines(lines: DataFrame, schema: str = CASE_SCHEMA) -> DataFrame:
    """Cases from a ``value`` column of JSON lines; blank, malformed and non-object lines drop."""
    # The parser stops after the first value, so a line must also end with its brace.
    whole = tx.strip("value").rlike(r"(?s)^\{.*\}$") & F.try_parse_json("value").isNotNull()
    return lines.where(whole).select(F.from_json("value", schema).alias("c")).select("c.*")


def load_eval_cases(spark: SparkSession, path: str, schema: str = CASE_SCHEMA) -> DataFrame:
    return cases_from_lines(spark.read.text(path), schema)


RULE_SCHEMA = "rule_no int, code string, name string, keywords array<string>, hit_level string, message string, template_tags array<string>"


def rule_rows(spark: SparkSession, records: list) -> DataFrame:
    """Rules as a small frame, in order; anything that is not a record is dropped."""
    listing = lambda v: [str(x) for x in v] if isinstance(v, list) else []
    text = lambda v: None if v is None else str(v)
    rows = [
        (n, str(r.get("code", "")), str(r.get("name", "")), listing(r.get("keywords")), str(r.get("hit_level", "warn")), text(r.get("message")), listing(r.get("template_tags")))
        for n, r in enumerate([r for r in records if isinstance(r, dict)], start=1)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def load_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of all YAML or JSON files of a folder, by file name.

    Rule files are configuration, so they are read on the driver.  YAML needs the yaml
    package; JSON works without it.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.{yaml,yml,json}").text(folder)
    records: list = []
    for row in sorted(files.select(F.col("_metadata.file_path").alias("p"), "value").collect(), key=lambda r: r.p):
        content = _parse_config(row.value, row.p)
        records.extend(content if isinstance(content, list) else [])
    return rule_rows(spark, records)


def _parse_config(text: str, path: str):
    if path.endswith(".json"):
        try:
            content = json.loads(text)
            return content if isinstance(content, list) else [content]
        except json.JSONDecodeError:
            return [json.loads(line) for line in text.splitlines() if line.strip()]
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading YAML rules needs the yaml package; use JSON rule files instead") from exc
    return yaml.safe_load(text)


def load_term_dictionary(spark: SparkSession, path: str) -> TermDictionary:
    """Term dictionary of all JSON files of a path, by file name; a missing path gives an empty one.

    Dictionaries are configuration, so they are read on the driver.  A broken file counts as empty, a read
    that fails is an error.
    """
    try:
        files = spark.read.option("wholetext", True).text(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return TermDictionary()
    rows = files.select(F.col("_metadata.file_path").alias("p"), "value").collect()
    parts = [TermDictionary.from_json(r.value.lstrip("\ufeff")) for r in sorted(rows, key=lambda r: r.p)]
    return TermDictionary(variants=tuple(v for d in parts for v in d.variants), entities=tuple(e for d in parts for e in d.entities))


def dictionary_rows(spark: SparkSession, dictionary: TermDictionary) -> DataFrame:
    """(alias, canonical, kind) rows of a dictionary."""
    rows = [(a, c, "variant") for a, c in dictionary.variant_pairs] + [(a, c, "alias") for a, c in dictionary.alias_pairs]
    return spark.createDataFrame(rows, "alias string, canonical string, kind string")


# Columns of the quality export.
QUALITY_CSV_COLUMNS = (
    "doc_uid", "doc_title", "ingest_status", "index_status", "section_count", "chunk_count", "fts_chunk_count", "vector_chunk_count",
    "avg_chunk_chars", "avg_chunks_per_section", "quality_level", "quality_message", "issues", "source_path",
)


def quality_csv_rows(quality: DataFrame, docs: DataFrame) -> DataFrame:
    joined = quality.join(docs.select("doc_uid", "doc_title", "source_path"), "doc_uid")
    return joined.withColumn("issues", F.array_join("issues", "；")).select(*QUALITY_CSV_COLUMNS)


def export_quality_csv(quality: DataFrame, docs: DataFrame, folder: str) -> None:
    """One CSV row per document, written in parallel with a header per file."""
    quality_csv_rows(quality, docs).write.mode("overwrite").option("header", True).csv(folder)


def append_job_log(log: DataFrame, folder: str) -> None:
    log.write.mode("append").parquet(folder)


def write_check_result(checks: DataFrame, claims: DataFrame, rule_hits: DataFrame, folder: str, run_id: str) -> None:
    """Three tables of one run; they become visible together, with the run's marker, written last.

    Every writing has folders of its own and the marker names the one that counts, so a run that is written again
    is the earlier one until it is whole.
    """
    own, attempt = quote(run_id, safe=""), uuid.uuid4().hex
    for name, table in (("checks", checks), ("claims", claims), ("rule_hits", rule_hits)):
        table.withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)}).write.parquet(f"{folder}/{name}/{own}/{attempt}")
    checks.sparkSession.createDataFrame([(run_id, attempt)], "run_id string, attempt string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs/{own}")


def read_check_result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of completed runs only, as last written."""
    read = lambda n: spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/{n}")
    return read(name).join(read("runs"), ["run_id", "attempt"], "left_semi").drop("attempt")
