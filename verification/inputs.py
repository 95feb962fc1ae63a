"""The operators' inputs, derived by Spark from the given tables.

Nothing here is a fixed sample: every table grows with the tables it is derived from.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.session import spread
from attestry.lexicons import CHECK_POLICY, ClaimLexicon, QuestionLexicon, RelationLexicon, TermDictionary
from attestry.operators import claims as cl
from attestry.plans.check import labelled_hits
from attestry.plans.corpus import Corpus, derive, shared_folder, store
from attestry.sources.files import rule_rows

# Lists for the pseudo-word corpus; the defaults of the library are for Chinese text.
DICTIONARY = TermDictionary(variants=(("thth", "thre"),), entities=(("thon", ("thor", "thnt")), ("erin", ("eron",))))
LOGIC = ClaimLexicon(
    exclusive=("thst",),
    universal=("erwh",),
    negation=("onnd",),
    comparison=("anon",),
    logic_words=("thst", "erwh", "onnd", "anon"),
    counter_exclusive=("ertion",),
    counter_universal=("ertion",),
    counter_negation=("ertion",),
    counter_comparison=("ertion",),
    unless_universal=("ertion",),
    topic_phrases=("ering", "onnd"),
    relation_words=("tion", "ing", "ment"),
    stop_phrases=("the", "que"),
    entity_ends=("er", "an", "es"),
    probe_exclusive="ertion thing",
    probe_universal="ering thing",
    probe_negation="oner thing",
    probe_comparison="onre thing",
)
RELATION = RelationLexicon(
    support=("thing",),
    refute=("ersh",),
    refute_phrases=(),
    condition=("erly",),
    example=("ernd",),
    method_context=("oner",),
    single_item_subject=("ering",),
    partial_effect=("onre",),
    claim_term=("tion", "ering", "ment"),
    stop_words=("the", "que"),
    whole_words=("andth",),
    caution=("ertion",),
)
QUESTION = QuestionLexicon(
    subject="ering",
    cut_phrases=("ering", "the"),
    compact_markers=("ering", "the"),
    expansions=(("thing", ("thing", "erthing"), 4), ("onre", ("onre",), 0)),
    generic_tree=("and", "that", "with", "this", "ering"),
    noisy_prefixes=("th",),
    noisy_suffixes=("th", "nd"),
    generic_chunk=("and", "that", "with", "this"),
    noisy_chunk=("ntth",),
    front_matter=("Ing", "The"),
    incidental=("ertion", "shth"),
    max_chunk_term=10,
    particle="qq",
    chunk_prefix="wh",
)
RULES = [
    {"code": "R1", "name": "rule one", "keywords": ["attion"], "hit_level": "warn", "message": "message one", "template_tags": ["general"]},
    {"code": "R2", "name": "rule two", "keywords": ["éeux", "ernd"], "hit_level": "error", "message": "message two", "template_tags": ["general", "strict"]},
    {"code": "R3", "name": "rule three", "keywords": ["ntble"], "hit_level": "block", "message": "message three", "template_tags": ["strict"]},
    {"code": "R4", "name": "rule four", "keywords": ["esing"], "template_tags": []},
]
REFERENCES = (r"(?:^|[ \n])(?:ering|thnt|thing) ([a-z]{3,12})", r"(?:^|[ \n])(?:anon) ([a-z]{3,12})")
REFERENCE_SPACING = r"^(er|th)([a-z])"

MARKDOWN = """array_join(transform(split(text, '\\n'), (l, j) -> CASE
    WHEN (j + 1) % 12 = 1 THEN concat('# ', l) WHEN (j + 1) % 12 = 5 THEN concat('## ', l)
    WHEN (j + 1) % 12 IN (7, 8) THEN concat('- ', l) WHEN (j + 1) % 12 = 10 THEN concat('> ', l)
    WHEN (j + 1) % 12 = 11 THEN concat('\\n', l) ELSE l END), '\\n')"""
EPOCH = 1704067200

_OPEN: dict[tuple[str, str], "Inputs"] = {}


def inputs(spark: SparkSession, sf_dir: str) -> "Inputs":
    """Inputs of one data folder, shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Inputs(spark, sf_dir)
    return _OPEN[key]


def as_texts(conversations: DataFrame) -> DataFrame:
    """Turns as texts to check, with knowledge base and tags."""
    return conversations.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("check_id"),
        F.col("text").alias("input_text"),
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("knowledge_base_id"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_at"),
        F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("general"))).otherwise(F.array(F.lit("strict"))).alias("tags"),
    )


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # Text tables come as one small file each here; their work is spread over the cores.
        keys = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}.get(name)
        return spread(df, *keys) if keys else df

    @cached_property
    def docs(self) -> DataFrame:
        """Documents in Markdown form."""
        d = self.table("documents")
        i = F.col("doc_id")
        return d.select(
            F.format_string("d%09d", i).alias("doc_uid"),
            F.col("source").alias("knowledge_base_id"),
            F.concat(F.lit("doc_"), i.cast("string")).alias("doc_id"),
            F.concat(F.lit("Document "), i.cast("string")).alias("doc_title"),
            F.when(i % 5 != 0, F.concat(F.lit("author "), (i % 7).cast("string"))).alias("author"),
            F.when(i % 3 != 0, F.col("lang")).alias("source_name"),
            F.when(i % 11 == 0, F.lit("[broken")).when(i % 4 != 0, F.concat(F.lit('["'), "lang", F.lit('","'), "source", F.lit('"]'))).alias("tags_json"),
            F.concat("source", F.lit("/doc_"), i.cast("string"), F.lit(".md")).alias("source_path"),
            F.expr(MARKDOWN).alias("content"),
            F.when(i % 23 == 0, "failed").otherwise("completed").alias("ingest_status"),
            F.when(i % 13 == 0, "pending").when(i % 17 == 0, "partial_failed").otherwise("indexed").alias("index_status"),
            F.timestamp_seconds(F.lit(EPOCH) + i * 60).alias("created_at"),
            F.timestamp_seconds(F.lit(EPOCH) + i * 60 + (i * 7919) % 5003).alias("updated_at"),
            i.alias("n"),
        )

    @cached_property
    def lazy(self) -> Corpus:
        """Derived tables as plans over the documents."""
        return derive(self.docs, DICTIONARY)

    @cached_property
    def corpus(self) -> Corpus:
        """Derived tables as stored index tables, written once per session."""
        name = hashlib.sha256(self.sf_dir.encode()).hexdigest()[:12]
        return store(self.lazy, shared_folder(self.spark, name))

    # ------------------------------------------------------------------ queries
    @cached_property
    def queries(self) -> DataFrame:
        """Each benchmark passage whole, and its two shortest words of five letters or more."""
        b = self.table("benchmark")
        words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), lambda w: F.length(w) >= 5)
        ranked = F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
        pair = F.array_join(F.slice(F.transform(ranked, lambda s: s["w"]), 1, 2), " ")
        return b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), "text").unionByName(
            b.select(F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("query_id"), pair.alias("text"))
        )

    @cached_property
    def scoped(self) -> DataFrame:
        """The same queries, each restricted to one knowledge base."""
        number = F.substring("query_id", 2, 20).cast("int")
        return self.queries.withColumn("knowledge_base_id", F.concat(F.lit("src"), (number % 20).cast("string")))

    @cached_property
    def questions(self) -> DataFrame:
        """Benchmark passages as questions to one knowledge base each."""
        i = F.col("item_id")
        return self.table("benchmark").select(
            i.alias("question_id"), F.col("text").alias("question"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("knowledge_base_id")
        )

    # ------------------------------------------------------------------ texts and claims
    @cached_property
    def texts(self) -> DataFrame:
        """Conversation turns as texts to check."""
        return as_texts(self.table("conversations"))

    @cached_property
    def claims(self) -> DataFrame:
        return cl.split_claims(self.texts)

    @cached_property
    def _labelled(self) -> tuple[DataFrame, DataFrame]:
        return labelled_hits(self.claims, self.corpus, CHECK_POLICY, LOGIC)

    @cached_property
    def claim_hits(self) -> DataFrame:
        """What the check's own search finds for every labelled query of every claim, stored once like the corpus; ids as bytes."""
        folder = shared_folder(self.spark, hashlib.sha256(self.sf_dir.encode()).hexdigest()[:12]) + "/claim_hits"
        hits = self._labelled[0].drop("query_id").withColumns({c: F.unhex(c) for c in ("claim_id", "chunk_id")})
        hits.write.mode("overwrite").option("compression", "zstd").parquet(folder)
        return self.spark.read.parquet(folder)

    @property
    def claim_queries(self) -> DataFrame:
        """The stored queries of that search."""
        return self._labelled[1]

    @cached_property
    def rules(self) -> DataFrame:
        return rule_rows(self.spark, RULES)

    # ------------------------------------------------------------------ reviews and users
    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def reviews(self) -> DataFrame:
        """Review events: the reviewed claim is the user, the action follows the event type."""
        kind = F.col("event_type")
        action = F.when(kind == "purchase", "approved").when(kind == "error", "rejected").when(kind == "click", "updated")
        return self.events.where(kind.isin("purchase", "error", "click")).select(
            F.col("event_id").alias("review_id"), F.col("user_id").alias("claim_id"), action.alias("review_action"), F.col("ts").alias("created_at")
        )

    @cached_property
    def review_claims(self) -> DataFrame:
        """One claim per user, ten to a check."""
        u = F.col("user_id")
        return (
            self.events.groupBy("user_id")
            .agg(F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("n"))
            .select(
                u.alias("claim_id"),
                F.floor(u / 10).cast("bigint").alias("check_id"),
                (u % 10).alias("claim_no"),
                F.concat(F.lit("claim of user "), u.cast("string")).alias("claim_text"),
                F.when(u % 3 == 0, "verified").when(u % 3 == 1, "needs_review").otherwise("rejected").alias("verdict"),
                F.when(u % 4 == 0, "high").when(u % 4 == 1, "medium").otherwise("low").alias("risk_level"),
                (F.col("n") % 5).alias("evidence_count"),
                "created_at",
            )
        )

    @cached_property
    def review_checks(self) -> DataFrame:
        c = F.col("check_id")
        return (
            self.review_claims.groupBy("check_id")
            .agg(F.min("created_at").alias("created_at"))
            .select("check_id", F.concat(F.lit("src"), (c % 20).cast("string")).alias("knowledge_base_id"), "created_at")
        )

    @cached_property
    def users(self) -> DataFrame:
        u = F.col("user_id")
        return self.events.select("user_id").distinct().withColumn("is_admin", u % 50 == 0)

    @cached_property
    def grants(self) -> DataFrame:
        u = F.col("user_id")
        kbs = F.array_distinct(F.array(F.concat(F.lit("src"), (u % 20).cast("string")), F.concat(F.lit("src"), ((u * 7) % 20).cast("string"))))
        return self.users.select("user_id", F.explode(kbs).alias("knowledge_base_id"))

