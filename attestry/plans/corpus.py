"""Documents to stored index tables: sections, chunks, chunk word sets, postings and vectors."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.session import checkpoint_folder
from attestry.lexicons import DEFAULT_DICTIONARY, TermDictionary
from attestry.operators import retrieval, shelves, structure, vectors
from attestry.operators.grams import GramIndex


@dataclass(frozen=True)
class Corpus:
    """The tables retrieval and checking read."""

    docs: DataFrame
    sections: DataFrame
    chunks: DataFrame
    word_sets: DataFrame
    vectors: DataFrame
    dictionary: TermDictionary = DEFAULT_DICTIONARY
    # The stored full-text index: rows of a term and the chunks of a block that have it, and the chunks of each term.
    postings: DataFrame | None = None
    frequencies: DataFrame | None = None
    # The stored n-gram indexes of chunks and sections.
    chunk_grams: GramIndex | None = None
    section_grams: GramIndex | None = None
    # The folder of the chunks stored by knowledge base.
    shelves: str | None = None


def derive(docs: DataFrame, dictionary: TermDictionary = DEFAULT_DICTIONARY) -> Corpus:
    """The derived tables as lazy frames; each is a narrow transformation of the documents."""
    chunks = structure.build_chunks(docs)
    return Corpus(
        docs=docs,
        sections=structure.parse_sections(docs),
        chunks=chunks,
        word_sets=retrieval.chunk_word_sets(chunks, dictionary),
        vectors=vectors.embed_hash(chunks),
        dictionary=dictionary,
    )


class StoredCorpus:
    """A corpus whose tables are written under a shared folder, each when it is first read.

    Sections and chunks are written with a number each, by which the indexes name them; word sets, vectors and
    indexes are derived from the stored rows. A query that reads chunks only makes and keeps no index.
    """

    def __init__(self, corpus: Corpus, folder: str, partition_by: str | None = None) -> None:
        self.source, self.folder, self.partition_by = corpus, folder, partition_by
        self.dictionary = corpus.dictionary

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if self.partition_by and self.partition_by in df.columns:
            writer = writer.partitionBy(self.partition_by)
        writer.parquet(f"{self.folder}/{name}")
        return df.sparkSession.read.parquet(f"{self.folder}/{name}")

    def _numbered(self, df: DataFrame, name: str) -> DataFrame:
        return self._write(df.withColumn("serial", F.monotonically_increasing_id()), name)

    @cached_property
    def docs(self) -> DataFrame:
        return self._write(self.source.docs, "docs")

    @cached_property
    def _sections(self) -> DataFrame:
        return self._numbered(structure.parse_sections(self.source.docs), "sections")

    @cached_property
    def _chunks(self) -> DataFrame:
        return self._numbered(structure.build_chunks(self.source.docs), "chunks")

    @cached_property
    def sections(self) -> DataFrame:
        return self._sections.drop("serial")

    @cached_property
    def chunks(self) -> DataFrame:
        return self._chunks.drop("serial")

    @cached_property
    def word_sets(self) -> DataFrame:
        return self._write(retrieval.chunk_word_sets(self._chunks, self.dictionary), "word_sets")

    @cached_property
    def vectors(self) -> DataFrame:
        return self._write(vectors.embed_hash(self.chunks), "vectors")

    @cached_property
    def postings(self) -> DataFrame:
        return self._write(retrieval.block_postings(self.word_sets), "postings")

    @cached_property
    def frequencies(self) -> DataFrame:
        return self._write(retrieval.block_frequencies(self.postings), "frequencies")

    @cached_property
    def chunk_grams(self) -> GramIndex:
        return retrieval.chunk_grams(self._chunks, f"{self.folder}/chunk_grams")

    @cached_property
    def section_grams(self) -> GramIndex:
        return retrieval.section_grams(self._sections, f"{self.folder}/section_grams")

    @cached_property
    def shelves(self) -> str:
        return shelves.write_shelves(self.chunks, f"{self.folder}/shelves", self.dictionary)

    def build(self) -> StoredCorpus:
        """All tables at once, for a service that answers many kinds of queries."""
        for name in ("docs", "sections", "chunks", "word_sets", "vectors", "postings", "frequencies", "chunk_grams", "section_grams"):
            getattr(self, name)
        return self


def store(corpus: Corpus, folder: str, partition_by: str | None = None) -> StoredCorpus:
    """The corpus with its tables stored under a shared folder, each written when it is first read."""
    return StoredCorpus(corpus, folder, partition_by)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/attestry/{spark.sparkContext.applicationId}/{name}"
