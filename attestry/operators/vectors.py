"""Vectors: hash embedding, exact and approximate nearest neighbours, upkeep."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from attestry.functions import text as tx
from attestry.functions.session import checkpoint_folder, cut_lineage, read_table

DIMENSION = 64
# Queries travel to the tasks in blocks of at most this many bytes, whatever their number.
QUERY_BYTES = 8 << 20
# Vectors that a task holds while the blocks pass, at most, in bytes; the next ones meet all blocks anew.
HELD_BYTES = 128 << 20
# Queries that the vectors of a cell are measured against at a time, and rows that a task sends on at a time.
STEP_ROWS = 8_192
# Vectors that the cells of the approximate index are trained on, at most.
TRAIN_ROWS = 20_000
# Vectors or queries of a cell that one task takes, at most.
PART_ROWS = 50_000


_CODES: dict[int, np.ndarray] = {}


def _codes(points: np.ndarray) -> np.ndarray:
    """Slot byte and weight (1 to 17) of code points, from the first two bytes of the character's MD5; kept by a worker."""
    for p in points.tolist():
        if p not in _CODES:
            made = hashlib.md5(chr(p).encode("utf-8", "surrogatepass")).digest()
            _CODES[p] = np.array([made[0], made[1] % 17 + 1])
    return np.array([_CODES[p] for p in points.tolist()], dtype=np.int64).reshape(-1, 2)


def character_sums(texts: list[str], dimension: int) -> np.ndarray:
    """One row a text: each character adds its weight to its slot; sums are whole numbers."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, place = np.unique(points.astype(np.int64), return_inverse=True)
    code = _codes(known)
    owner = np.repeat(np.arange(len(texts)), length)
    total = np.bincount(owner * dimension + (code[:, 0] % dimension)[place], code[:, 1][place], len(texts) * dimension)
    return total.reshape(len(texts), dimension)


def averaged(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The vectors of slot sums and text lengths."""
    return sums / 17.0 / np.maximum(length, 1)[:, None]


def bag_of_characters(texts: list[str], dimension: int) -> np.ndarray:
    """One row a text: the sums of its slots over the length."""
    return averaged(character_sums(texts, dimension), np.array([len(t) for t in texts], dtype=np.int64))


def hash_sums(text: Column, dimension: int = DIMENSION) -> Column:
    """Slot sums of the stripped text, from which and its length the vector is made; null for null."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = character_sums(batch.fillna("").tolist(), dimension).astype(np.int32)
            yield pd.Series([None if absent else row for absent, row in zip(batch.isna(), rows)], dtype=object)

    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, "array<int>")(tx.strip(text))


def hash_vector(text: Column, dimension: int = DIMENSION) -> Column:
    """Bag-of-characters vector of the stripped text; zeros for an empty one, null for null.

    A batch of texts is one table look-up and one sum, in Arrow batches.
    """

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = bag_of_characters(batch.fillna("").tolist(), dimension)
            yield pd.Series([None if absent else row for absent, row in zip(batch.isna(), rows)], dtype=object)

    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, "array<double>")(tx.strip(text))


def embed_hash(chunks: DataFrame, dimension: int = DIMENSION, text: str = "content") -> DataFrame:
    keep = [c for c in chunks.columns if c in ("chunk_id", "query_id", "doc_uid", "knowledge_base_id")]
    return chunks.select(*keep, hash_vector(F.col(text), dimension).alias("embedding"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=float)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """Top k per query by (distance, chunk_id); the limit is applied before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(
            "query_id",
            "rank",
            "chunk_id",
            "doc_uid",
            (1 - F.col("distance")).alias("score"),
            F.lit(None).cast("double").alias("rerank_score"),
            F.lit("vector").alias("retrieval_source"),
            F.array(F.lit("vector")).alias("matched_sources"),
        )
    )


FILTERS = ("doc_uid", "knowledge_base_id")


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Exact k nearest chunks per query by squared distance; score is 1 - distance.

    ``queries`` is (query_id, embedding) with optional doc_uid / knowledge_base_id filters, which hold
    before anything is measured.  Queries are stored in numbered blocks; every task takes its vectors against
    one block after the other and keeps k rows a query, so the driver sees the number of blocks only and the
    plan is the same for any number of queries.
    """
    return _ranked(_blockwise(queries, vectors, k), k)


def store_query_blocks(queries: DataFrame) -> tuple[str, int]:
    """Folder and number of the blocks that the queries are written in, each of about ``QUERY_BYTES``."""
    spark = queries.sparkSession
    filters = [c for c in FILTERS if c in queries.columns]
    rows = queries.select("query_id", "embedding", *filters).where(F.col("embedding").isNotNull())
    rows = cut_lineage(rows)
    size = rows.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // QUERY_BYTES))
    folder = f"{checkpoint_folder(spark).rstrip('/')}/queries-{uuid.uuid4().hex}"
    rows.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    return folder, blocks


_block: dict[tuple[str, int], dict] = {}


def _read_block(folder: str, number: int) -> dict:
    """A block of queries; a worker keeps the one that it has read last."""
    if (folder, number) not in _block:
        _block.clear()
        _block[(folder, number)] = _as_block(read_table(f"{folder}/block={number}"))
    return _block[(folder, number)]


def _points(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long vectors as one matrix, from its values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    values = column.flatten().to_numpy(zero_copy_only=False)
    length = np.diff(column.offsets.to_numpy())
    if (length != length[0]).any():
        raise ValueError("vectors of different lengths")
    return values.reshape(len(column), int(length[0]))


def _as_block(rows: pa.Table) -> dict:
    return {
        "ids": rows["query_id"].to_numpy(),
        "matrix": _points(rows["embedding"]).astype(float),
        "filters": {c: rows[c].to_pylist() for c in FILTERS if c in rows.column_names},
    }


class _Nearest:
    """Running top k per query over the batches of a task."""

    def __init__(self, block: dict, k: int) -> None:
        self.block, self.k = block, k
        self.q = block["matrix"]
        self.bound = np.full(len(self.q), np.inf)
        self.parts: list[pd.DataFrame] = []
        self.held = 0
        self.known = {c: {v: n for n, v in enumerate(dict.fromkeys(x for x in values if x is not None))} for c, values in block["filters"].items()}
        self.wanted = {c: np.array([-1 if v is None else self.known[c][v] for v in values]) for c, values in block["filters"].items()}

    def add(self, batch: dict) -> None:
        """Vectors as ``_held`` has them."""
        points = batch["points"].astype(float)
        square = np.einsum("ij,ij->i", points, points)
        codes = {c: np.array([known.get(v, -2) for v in batch[c]]) for c, known in self.known.items()}
        step = max(1, (1 << 20) // max(1, len(points)))
        for low in range(0, len(self.q), step):
            q = self.q[low : low + step]
            gap = square[:, None] + np.einsum("ij,ij->i", q, q)[None, :] - 2 * (points @ q.T)
            for c, wanted in self.wanted.items():
                w = wanted[low : low + step]
                gap[(w[None, :] >= 0) & (codes[c][:, None] != w[None, :])] = np.inf
            limit = self.bound[low : low + step]
            if np.isinf(limit).any():
                limit = np.minimum(np.partition(gap, min(self.k, len(gap)) - 1, axis=0)[min(self.k, len(gap)) - 1], limit)
            limit = limit + 1e-5  # the product is good to far less
            row, col = np.nonzero((gap <= limit) & np.isfinite(gap))
            away = points[row] - q[col]
            self.parts.append(
                pd.DataFrame({"q": col + low, "distance": np.round(np.einsum("ij,ij->i", away, away), 6), "chunk_id": batch["chunk_id"][row], "doc_uid": batch["doc_uid"][row]})
            )
            self.held += len(row)
        if self.held > 4 * self.k * len(self.q) + 100_000:
            self.cut()

    def cut(self) -> pd.DataFrame:
        rows = pd.concat(self.parts) if self.parts else pd.DataFrame({"q": [], "distance": [], "chunk_id": [], "doc_uid": []})
        rows = rows.sort_values(["q", "distance", "chunk_id"], kind="stable")
        rows = rows[rows.groupby("q").cumcount() < self.k]
        self.parts, self.held = [rows], len(rows)
        full = rows.groupby("q")["distance"].agg(["size", "max"])
        full = full[full["size"] == self.k]
        self.bound[full.index.to_numpy(dtype=int)] = full["max"].to_numpy()
        return rows

    def rows(self, schema: pa.Schema) -> pa.Table:
        rows = self.cut()
        ids = self.block["ids"][rows["q"].to_numpy(dtype=int)]
        columns = [ids, rows["chunk_id"].to_numpy(), rows["doc_uid"].to_numpy(), rows["distance"].to_numpy(dtype=float)]
        return pa.table([pa.array(v, f.type, from_pandas=True) for v, f in zip(columns, schema)], schema=schema)


def _held(batch: pa.RecordBatch | pa.Table, points: np.ndarray) -> dict:
    """Ids, filters and matrix of some vectors, without the rows they came in."""
    return {"points": points, **{c: batch[c].to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[c].to_numpy() for c in batch.schema.names if c not in ("embedding", "cell", "v_part", "q_part")}}


def _cells(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin(np.einsum("ij,ij->i", centroids, centroids)[None, :] - 2 * (points @ centroids.T), axis=1)


def _schema(queries: DataFrame, vectors: DataFrame) -> T.StructType:
    kinds = {"query_id": queries.schema["query_id"].dataType, **{c: vectors.schema[c].dataType for c in ("chunk_id", "doc_uid")}, "distance": T.DoubleType()}
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def _needed(queries: DataFrame) -> list[str]:
    return list(dict.fromkeys(["chunk_id", "doc_uid", *[c for c in FILTERS if c in queries.columns], "embedding"]))


def _blockwise(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Each task's k best per query, block after block of the stored queries."""
    folder, blocks = store_query_blocks(queries)
    schema = _schema(queries, vectors)
    arrow, step, most = to_arrow_schema(schema), STEP_ROWS, HELD_BYTES

    def nearest(held: Iterable[dict]) -> Iterator[pa.RecordBatch]:
        for number in range(blocks):
            near = _Nearest(_read_block(folder, number), k)
            for batch in held:
                if len(near.q):
                    near.add(batch)
            if near.parts:
                yield from near.rows(arrow).to_batches(step)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (_held(batch, _points(batch["embedding"])) for batch in batches if len(batch))
        if blocks == 1:  # vectors stream by
            yield from nearest(made)
            return
        held, size = [], 0
        for batch in made:
            held.append(batch)
            size += batch["points"].nbytes
            if size >= most:
                yield from nearest(held)
                held, size = [], 0
        if held:
            yield from nearest(held)

    return vectors.select(*_needed(queries)).where(F.col("embedding").isNotNull()).mapInArrow(best, schema)


def train_cells(vectors: DataFrame, cells: int, rows: int = TRAIN_ROWS, rounds: int = 12) -> np.ndarray:
    """k-means centroids from at most ``rows`` vectors, chosen by a hash of their id."""
    sample = vectors.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(rows).collect()
    points = np.array([r["embedding"] for r in sample], dtype=float)
    if not len(points):
        return np.zeros((1, 1))
    centroids = points[np.unique(np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int))]
    for _ in range(rounds):
        near = _cells(points, centroids)
        count = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, points)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


@dataclass(frozen=True)
class CellIndex:
    """Vectors stored by cell (a partition column), the cells' centres and how many vectors each has."""

    vectors: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray


def _near_cells(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = np.array([np.asarray(e, dtype=float) for e in batch["embedding"]])
            yield batch.assign(cell=_cells(points, centroids) if len(batch) else [])

    return run


def build_cells(vectors: DataFrame, cells: int = 128, folder: str | None = None) -> CellIndex:
    """Assign every vector to its nearest centre and store the vectors by cell, once for all searches."""
    spark = vectors.sparkSession
    folder = folder or f"{checkpoint_folder(spark).rstrip('/')}/cells-{uuid.uuid4().hex}"
    table = vectors.select(*[c for c in vectors.columns if c in ("chunk_id", "embedding", *FILTERS)]).where(F.col("embedding").isNotNull())
    centroids = train_cells(table, cells)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields) + ", cell int"
    placed = table.mapInPandas(_near_cells(centroids), schema)
    # A large cell is written by many tasks, a small one by one.
    placed.repartition(F.col("cell"), F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.partitionBy("cell").parquet(folder)
    stored = spark.read.schema(schema).parquet(folder)
    sizes = np.zeros(len(centroids), np.int64)
    for row in stored.groupBy("cell").count().collect():  # a row a cell
        sizes[row["cell"]] = row["count"]
    return CellIndex(stored, centroids, sizes)


def _opening(centroids: np.ndarray, sizes: np.ndarray, share: float, step: int):
    """Queries once for each cell that they open, in batches of about ``step`` rows."""
    limit, width = share * sizes.sum(), max(1, step // len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), width):
                batch = whole.slice(low, width)
                points = _points(batch["embedding"]).astype(float)
                order = np.argsort(np.einsum("ij,ij->i", centroids, centroids)[None, :] - 2 * (points @ centroids.T), axis=1)
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                row, place = np.nonzero((before < limit) & (sizes[order] > 0))
                out = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(order[row, place].astype(np.int32))], [*out.schema.names, "cell"])

    return run


def _opened(queries: DataFrame, index: CellIndex, share: float) -> DataFrame:
    """The queries, once for each cell that they open: the nearest ones that together have ``share`` of the vectors."""
    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())])
    return queries.mapInArrow(_opening(index.centroids, index.sizes, share, STEP_ROWS), schema)


def _by_cell(queries: DataFrame, index: CellIndex, k: int, share: float) -> DataFrame:
    """k best per query and part of a cell: a block of a cell's vectors against a block of the queries that open it.

    Cells that no query opens are not read.  A cell with more than ``PART_ROWS`` vectors or queries is cut, and every
    block of the one side meets every block of the other, so no task holds a whole cell.
    """
    filters = [c for c in FILTERS if c in queries.columns]
    asked = cut_lineage(_opened(queries.select("query_id", "embedding", *filters).where(F.col("embedding").isNotNull()), index, share))
    wanted = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row a cell
    spark = queries.sparkSession
    parts = [(c, -(-int(index.sizes[c]) // PART_ROWS), -(-n // PART_ROWS)) for c, n in wanted.items()]
    cut = F.broadcast(spark.createDataFrame(parts, "cell int, v_parts long, q_parts long"))
    v = index.vectors.where(F.col("cell").isin(sorted(wanted))).select(*_needed(queries), "cell").join(cut, "cell")
    v = v.withColumn("v_part", F.pmod(F.xxhash64("chunk_id"), "v_parts")).withColumn("q_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts") - 1)))
    q = asked.join(cut, "cell")
    q = q.withColumn("q_part", F.pmod(F.xxhash64("query_id"), "q_parts")).withColumn("v_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("v_parts") - 1)))

    schema = _schema(queries, index.vectors)
    arrow, step = to_arrow_schema(schema), STEP_ROWS

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = [arrow.empty_table()]
        if len(vectors) and len(queries):
            held = _held(vectors, _points(vectors["embedding"]))
            for low in range(0, len(queries), step):
                near = _Nearest(_as_block(queries.slice(low, step).combine_chunks()), k)
                near.add(held)
                found.append(near.rows(arrow))
        return pa.concat_tables(found)

    key = ["cell", "v_part", "q_part"]
    return v.drop("v_parts", "q_parts").groupBy(*key).cogroup(q.drop("v_parts", "q_parts").groupBy(*key)).applyInArrow(best, schema)


def vector_search_cells(queries: DataFrame, vectors: DataFrame, k: int = 10, cells: int = 64) -> DataFrame:
    """The search through cells with all of them open: exact, and the measure of the approximate one."""
    return _ranked(_by_cell(queries, build_cells(vectors, cells), k, 1.0), k)


def vector_search_approx(queries: DataFrame, vectors: DataFrame | CellIndex, k: int = 10, *, cells: int = 128, share: float = 0.5) -> DataFrame:
    """Approximate neighbours: only the stored cells nearest to a query, with ``share`` of the vectors, are measured.

    Every vector is in the index, which may be built beforehand.  Filters hold before the measuring.  A query that
    finds fewer than k rows in its cells is answered by the exact search, so all have k rows where there are as many.
    """
    index = vectors if isinstance(vectors, CellIndex) else build_cells(vectors, cells)
    near = cut_lineage(_ranked(_by_cell(queries, index, k, share), k))
    full = near.where(F.col("rank") == k).select("query_id")
    short = queries.join(full, "query_id", "left_anti")
    return near.join(full, "query_id", "left_semi").unionByName(vector_search(short, index.vectors, k))


def rebuild_vectors(chunks: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """Counts of a full recomputation; the vectors themselves come from ``embed_hash``."""
    fresh = embed_hash(chunks, dimension)
    return fresh.where(F.size("embedding") == dimension).agg(
        F.count_distinct("doc_uid").alias("document_count"), F.count(F.lit(1)).alias("chunk_count")
    )


def check_vector_dimension(vectors: DataFrame, texts: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """Stored vectors, those of another dimension recomputed from their text.

    ``vectors`` is (chunk_id, embedding), ``texts`` (chunk_id, content).
    """
    stale = F.size("embedding") != dimension
    redone = vectors.where(stale).select("chunk_id").join(texts, "chunk_id").select(
        "chunk_id", hash_vector(F.col("content"), dimension).alias("embedding"), F.lit(True).alias("recomputed")
    )
    kept = vectors.where(~stale).select(
        "chunk_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.lit(False).alias("recomputed")
    )
    return kept.unionByName(redone)


def index_consistency(chunks: DataFrame, posting_chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks, indexed chunks and vectors per document, and whether they agree."""
    count = lambda df, name: df.groupBy("doc_uid").agg(F.count_distinct("chunk_id").alias(name))
    joined = (
        count(chunks, "chunk_count")
        .join(count(posting_chunks, "indexed_count"), "doc_uid", "full_outer")
        .join(count(vectors, "vector_count"), "doc_uid", "full_outer")
        .na.fill(0)
    )
    return joined.withColumn(
        "consistent", (F.col("chunk_count") == F.col("indexed_count")) & (F.col("chunk_count") == F.col("vector_count"))
    )
