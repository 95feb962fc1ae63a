"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive, so a batch of inserts, deletes and revised
counts is summed to signed deltas (with map-side sums, whatever the skew) and added to the last totals. Each
committed batch is one folder, named by its number and id and whole once Spark's marker is in it; a batch that
is sent again finds its folder and changes nothing, a batch that failed half-way is written anew.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import store

KEYS = ("source", "lang", "tokenizer")
#: Tokenizer versions: name and count of a text's tokens.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "chars4-1": lambda text: F.ceil(F.length(text) / 4),
}


def signed(changes: DataFrame) -> DataFrame:
    """Deltas of a batch: one row a key with the change in documents and tokens.

    ``changes`` has ``change`` (insert, delete, revise), the keys, ``n_tokens`` and, for a revision,
    ``old_n_tokens``. A revision that moves a document to other keys is a delete and an insert. Null keys are
    a key like others, null counts are 0, other kinds of change count for nothing.
    """
    kind = F.col("change")
    tokens, old = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_n_tokens", F.lit(0)).cast("long")
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).otherwise(0).cast("long")
    more = F.when(kind == "insert", tokens).when(kind == "delete", -tokens).when(kind == "revise", tokens - old).otherwise(0)
    return changes.groupBy(*KEYS).agg(F.sum(docs).alias("n_docs"), F.sum(more).alias("n_tokens"))


class Rollup:
    """Totals in a shared folder; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _committed(self) -> list[str]:
        """Names of whole batches, oldest first. A folder that can't be listed is an error, not an empty rollup."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        found = [s.getPath() for s in files.listStatus(top) if s.isDirectory()]
        return sorted(p.getName() for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def totals(self) -> DataFrame:
        """The totals after the last commit; keys without documents and tokens are left out."""
        names = self._committed()
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{names[-1]}").where("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; false if it has been committed before."""
        names = self._committed()
        if batch in {n.split("-", 1)[1] for n in names}:
            return False
        both = reduce(DataFrame.unionByName, [signed(changes), self.totals()])
        added = both.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        added.write.mode("overwrite").parquet(f"{self.folder}/{len(names):08d}-{batch}")
        return True


def counted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``source``, ``lang``, a digest of the text and its count by every tokenizer; null text counts 0."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return documents.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), "source", "lang", F.md5(text).alias("digest"), *[f(text).cast("long").alias(name) for name, f in TOKENIZERS.items()]
    )


def changes(rows: DataFrame, change: str, tokenizer: str) -> DataFrame:
    return rows.select(F.lit(change).alias("change"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(f"`{tokenizer}`").alias("n_tokens"), F.lit(None).cast("long").alias("old_n_tokens"))


def op8_delta_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; copies of an earlier text go again (a batch that is sent twice); then the French
    ones are counted anew by the next tokenizer version."""
    rows = store.stored(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")), "counted")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"))
    marked = store.stored(rows.join(first, "digest").withColumn("copy", F.col("id") > F.col("first")).drop("digest", "first"), "marked")
    rollup = Rollup(spark, store.shared(spark, "rollup"))
    rollup.commit("load", changes(marked, "insert", "words-1"))
    for _ in range(2):
        rollup.commit("copies", changes(marked.where("copy"), "delete", "words-1"))
    french = marked.where("not copy and lang = 'fr'")
    rollup.commit("tokenizer", changes(french, "delete", "words-1").unionByName(changes(french, "insert", "chars4-1")))
    return rollup.totals()
