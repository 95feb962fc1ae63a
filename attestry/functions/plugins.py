"""User-supplied scorers: embedding, reranking, judging.

The callables run in Arrow batches on the executors; a failure falls back to what the
tables already hold and never stops the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators.claims import merge_verdicts, parse_model_output

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Reranker = Callable[[str, Sequence[str]], Sequence[tuple[int, float]]]
Judge = Callable[[str, str], str]


def _halving(call: Embedder, texts: list[str]) -> list[list[float]]:
    """The embedder's vectors; a failing batch is halved, down to one text."""
    try:
        return [list(map(float, v)) for v in call(texts)]
    except Exception:
        if len(texts) == 1:
            raise
        middle = len(texts) // 2
        return _halving(call, texts[:middle]) + _halving(call, texts[middle:])


def embed_with(chunks: DataFrame, embedder: Embedder, batch: int = 8, text: str = "content") -> DataFrame:
    """Chunks with the embedder's vectors, asked for in batches of ``batch`` texts."""
    keep = [c for c in chunks.columns if c in ("chunk_id", "query_id", "doc_uid", "knowledge_base_id")]
    types = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].tolist()
            vectors: list[list[float]] = []
            for start in range(0, len(texts), batch):
                vectors.extend(_halving(embedder, texts[start : start + batch]))
            out = frame[keep].copy()
            out["embedding"] = vectors
            yield out

    return chunks.select(*keep, text).mapInPandas(run, f"{types}, embedding array<double>")


def rerank_with(hits: DataFrame, queries: DataFrame, chunks: DataFrame, reranker: Reranker) -> DataFrame:
    """(query_id, item_index, relevance_score) for ``apply_rerank``.

    A query's hits are a top-k list, so a group is at most k rows.  A query whose call fails
    gets no scores and so keeps its order.
    """
    rows = hits.select("query_id", "rank", "chunk_id").join(chunks.select("chunk_id", "content"), "chunk_id").join(queries.select("query_id", "text"), "query_id")
    kind = hits.schema["query_id"].dataType.simpleString()

    def score(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        try:
            results = list(reranker(group["text"].iloc[0], group["content"].tolist()))
        except Exception:
            results = []
        return pd.DataFrame(
            {
                "query_id": pd.Series([group["query_id"].iloc[0]] * len(results), dtype=object),
                "item_index": pd.Series([int(i) for i, _ in results], dtype="int32"),
                "relevance_score": pd.Series([float(s) for _, s in results], dtype="float64"),
            }
        )

    return rows.groupBy("query_id").applyInPandas(score, f"query_id {kind}, item_index int, relevance_score double")


def judge_with(prompts: DataFrame, heuristic: DataFrame, judge: Judge) -> DataFrame:
    """Verdicts merged from the model's answers and the heuristic ones.

    ``prompts`` is (claim_id, prompt); a failed call or an answer without a JSON object
    leaves the heuristic verdict.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(prompt: str):
            try:
                return judge("", prompt)
            except Exception:
                return None

        for prompts_batch in batches:
            yield prompts_batch.map(one)

    answers = parse_model_output(prompts.select("claim_id", ask("prompt").alias("output"))).where("parsed")
    return merge_verdicts(heuristic, answers.drop("parsed"))
