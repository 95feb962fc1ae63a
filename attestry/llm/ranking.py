"""Ranked lexical search by two trees.

Documents are read once: every task turns its texts into blocks of rows (ids, lengths) and columns (terms of the
items, how often), which are stored; counts over all documents come from these blocks. A block of documents is then
a tree whose nodes hold, for each term, the most that a document below contributes; the items are a tree whose nodes
hold the most that an item below weighs the term. The product of two nodes bounds every score between them, so a
pair of nodes goes as a whole once its bound is below the weakest k-th score of its items, and what is left is scored
exactly. Scores are whole numbers, in doubles while they are below 2^53, so bounds and ties are exact.

Items are a stored table of numbered groups. Tasks read a group from the shared folder; the driver sees their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm import store, texts

TOP = 20
GROUP_BYTES = 1 << 20  # of items that are searched in one pass over the documents
TREE_BYTES = 64 << 10  # of items in a tree
FANOUT = 8
CELLS = 4 << 20  # of a dense block of documents and terms
DOCS = 1024  # in a block at most
EXACT = 1 << 53
BLOCK = "ids binary, present binary, lengths binary, row binary, term binary, times binary, docs long, terms long, held array<int>, df array<int>"


# ------------------------------------------------------------------ items
def numbered_items(items: DataFrame, id_col: str, text_col: str) -> tuple[str, int, DataFrame]:
    """Folder of the items in numbered groups of at most ``GROUP_BYTES`` (or one item), number of groups, and the
    table of ``item`` (a number) and ``item_id``."""
    spark = items.sparkSession
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    serial = F.monotonically_increasing_id()
    rows = store.stored(rows.withColumn("part", F.shiftright(serial, 33)).withColumn("item", serial), "items")
    size = F.octet_length("text").cast("long") + 64
    parts, bases, before = sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum(size)).collect()), [], 0  # one row a partition
    for part, n in parts:
        bases.append((part, before))
        before += n
    rows = rows.join(F.broadcast(spark.createDataFrame(bases, "part long, base long")), "part")
    upto = F.sum(size).over(Window.partitionBy("part").orderBy("item")) - size + F.col("base")
    rows = rows.withColumn("own", F.floor(upto / GROUP_BYTES).cast("long"))
    groups = sorted(r.own for r in rows.select("own").distinct().collect())  # as many as passes over the documents
    numbers = spark.createDataFrame([(g, k) for k, g in enumerate(groups)], "own long, pass long")
    folder = store.shared(spark, "item-groups")
    rows.join(F.broadcast(numbers), "own").select("pass", "item", "text").repartition(max(1, len(groups)), "pass").write.partitionBy("pass").parquet(folder)
    return folder, len(groups), rows.select("item", "item_id")


@dataclass
class Items:
    """A group of items: their numbers, the sorted hashes of all terms, and for each item its terms and how often they stand."""

    numbers: np.ndarray
    sizes: np.ndarray  # bytes
    vocabulary: np.ndarray
    bounds: np.ndarray
    term: np.ndarray
    times: np.ndarray


def _hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for low, high, raw, at in texts.blocks(column):
        _, _, hashes, bounds = texts.words(texts.LOWER[raw], at, texts.ALNUM_WORD)
        yield low, high, hashes, bounds


def _read_items(folder: str, number: int) -> Items:
    place = f"{folder}/pass={number}"
    system, path = fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet"))
    table = pa.concat_tables([pq.read_table(f, filesystem=system, partitioning=None) for f in found]).sort_by("item").combine_chunks()
    column = table["text"].combine_chunks()
    hashes, bounds = [], [np.zeros(1, np.int64)]
    for _, _, h, b in _hashed(column):
        bounds.append(b[1:] + bounds[-1][-1])
        hashes.append(h)
    hashes, bounds = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate(bounds)
    vocabulary, term = np.unique(hashes, return_inverse=True)
    keys, times = np.unique(texts.owners(bounds) * len(vocabulary) + term, return_counts=True)
    owner = keys // max(1, len(vocabulary))
    return Items(table["item"].to_numpy(), np.diff(texts.utf8(column)[1]), vocabulary, np.searchsorted(owner, np.arange(len(bounds))), keys % max(1, len(vocabulary)), times)


_kept: dict[tuple[str, int], Items] = {}


def items_of(folder: str, number: int) -> Items:
    """The group, read once by a worker; one group is kept."""
    if (folder, number) not in _kept:
        _kept.clear()
        _kept[(folder, number)] = _read_items(folder, number)
    return _kept[(folder, number)]


# ------------------------------------------------------------------ documents
def _indexed(folder: str, number: int):
    def run(batches):
        items = items_of(folder, number)
        held: list[tuple] = []

        def block():
            # A matrix of the documents: rows in order, their terms in order, and each term's number of documents.
            ids = np.concatenate([h[0] for h in held])
            present, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            before = np.cumsum([0] + [len(h[0]) for h in held])
            row, term, times = np.concatenate([h[3] + b for h, b in zip(held, before)]), np.concatenate([h[4] for h in held]), np.concatenate([h[5] for h in held])
            terms, df = np.unique(term, return_counts=True)
            raw = [ids.astype("<i8"), present.astype("u1"), lengths.astype("<i8"), row.astype("<i4"), term.astype("<i4"), times.astype("<i4")]
            stats = [pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), pa.array([terms.astype(np.int32)], pa.list_(pa.int32())), pa.array([df.astype(np.int32)], pa.list_(pa.int32()))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in raw] + stats, [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            ids = batch["id"]
            for low, high, hashes, bounds in _hashed(batch["text"]):
                lengths = np.diff(bounds)
                if len(items.vocabulary):
                    at = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
                    mine = items.vocabulary[at] == hashes
                    keys, times = np.unique(texts.owners(bounds)[mine] * len(items.vocabulary) + at[mine], return_counts=True)
                    row, term = keys // len(items.vocabulary), keys % len(items.vocabulary)
                else:
                    row = term = times = np.zeros(0, np.int64)
                own = ids.slice(low, high - low)
                held.append((own.fill_null(0).to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False), lengths, row, term, times))
                if sum(len(h[0]) for h in held) >= DOCS:
                    yield block()
        if held:
            yield block()

    return run, BLOCK


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Whole-number weights of terms in ``df`` of ``n`` documents."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(times: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term that stands so often in a document of that length adds for each unit of its weight."""
    m = 100 - 25 + (25 * lengths.astype(np.int64) * n) // max(1, total)
    return (1_000_000_000 * times.astype(np.int64)) // (1000 * times.astype(np.int64) + 12 * m)


# ------------------------------------------------------------------ trees
@dataclass
class Tree:
    """Members in an order that puts like ones side by side, and the maxima of each level: members first, one root last."""

    order: np.ndarray
    levels: list[np.ndarray]

    @staticmethod
    def over(matrix: np.ndarray, weight: np.ndarray) -> Tree:
        """``weight`` scales the columns for the order: members with the same heaviest column are neighbours."""
        if matrix.shape[1]:
            scaled = matrix * weight
            order = np.lexsort((-scaled.max(1), scaled.argmax(1)))
        else:
            order = np.arange(len(matrix))
        levels = [matrix[order]]
        while len(levels[-1]) > 1:
            levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FANOUT), axis=0))
        return Tree(order, levels)


class Best:
    """The highest-scoring documents of each item so far: by score, then by id, rows without id last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.n = k, np.zeros(items, np.int64)
        self.score = np.zeros((items, k), np.int64)
        self.id = np.zeros((items, k), np.int64)
        self.absent = np.zeros((items, k), bool)

    def weakest(self) -> np.ndarray:
        """The least score by which a document can still come in: the k-th one (then its id decides), or 1."""
        return np.where(self.n == self.k, self.score[:, -1], 1)

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        n = self.n[item]
        s, i, a = np.concatenate([self.score[item, :n], score]), np.concatenate([self.id[item, :n], ids]), np.concatenate([self.absent[item, :n], absent])
        order = np.lexsort((i, a, -s))[: self.k]
        n = self.n[item] = len(order)
        self.score[item, :n], self.id[item, :n], self.absent[item, :n] = s[order], i[order], a[order]


def search(items: Tree, docs: Tree, best: Best, ids: np.ndarray, absent: np.ndarray) -> int:
    """Add the documents of a tree to the items' best ones; returns the number of pairs that were scored.

    A stack holds a document node and those item nodes of one level whose pairs with it are open. The wider side is
    opened, its children are bounded against the other side in one product, and a pair below the weakest k-th score
    of its items goes with all that is below it.
    """
    weakest = best.weakest()[items.order]
    floor = [weakest]
    for _ in items.levels[1:]:
        floor.append(np.minimum.reduceat(floor[-1], np.arange(0, len(floor[-1]), FANOUT)))
    scored = 0
    todo = [(len(items.levels) - 1, np.zeros(1, np.int64), len(docs.levels) - 1, 0)]
    while todo:
        p, those, q, node = todo.pop()
        if p and p >= q:
            those = (those[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            those = those[those < len(items.levels[p - 1])]
            those = those[items.levels[p - 1][those] @ docs.levels[q][node] >= floor[p - 1][those]]
            if len(those):
                todo.append((p - 1, those, q, node))
            continue
        if q > 1 or p:
            children = np.arange(node * FANOUT, min((node + 1) * FANOUT, len(docs.levels[q - 1])))
            bound = docs.levels[q - 1][children] @ items.levels[p][those].T
            for c in np.argsort(bound.sum(1), kind="stable"):  # the most promising child is popped first
                left = those[bound[c] >= floor[p][those]]
                if len(left):
                    todo.append((p, left, q - 1, int(children[c])))
            continue
        those = those[items.levels[0][those] @ docs.levels[q][node] >= weakest[those]]  # floors may have risen meanwhile
        if not len(those):
            continue
        low, high = (node * FANOUT, min((node + 1) * FANOUT, len(docs.levels[0]))) if q else (node, node + 1)
        score = docs.levels[0][low:high] @ items.levels[0][those].T
        scored += score.size
        members = docs.order[low:high]
        for j in np.flatnonzero((score >= weakest[those]).any(0)):
            good = score[:, j] >= weakest[those[j]]
            best.add(items.order[those[j]], score[good, j].astype(np.int64), ids[members[good]], absent[members[good]])
        kept = best.weakest()[items.order[those]]
        for j in np.flatnonzero(kept > weakest[those]):  # scores rise, so do the floors above the item
            at = those[j]
            weakest[at] = kept[j]
            for level in range(1, len(floor)):
                at //= FANOUT
                least = floor[level - 1][at * FANOUT : (at + 1) * FANOUT].min()
                if least == floor[level][at]:
                    break
                floor[level][at] = least
    return scored


def _parts(items: Items) -> list[slice]:
    """Runs of items for one tree each: bounded bytes, or one item."""
    out, low = [], 0
    upto = np.cumsum(items.sizes)
    while low < len(items.numbers):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + TREE_BYTES, "right")))
        out.append(slice(low, high))
        low = high
    return out


def _dense(rows: int, columns: int, row: np.ndarray, column: np.ndarray, value: np.ndarray, kind: type) -> np.ndarray:
    out = np.zeros((rows, columns), kind)
    out[row, column] = value
    return out


def _searched(folder: str, number: int, k: int, n: int, total: int, df: np.ndarray):
    def run(batches):
        items = items_of(folder, number)
        weight = weights(np.pad(df, (0, len(items.vocabulary) - len(df))), n)
        made = []  # of each part: its columns among the group's terms, the items' tree and its best documents
        for part in _parts(items):
            span = slice(items.bounds[part.start], items.bounds[part.stop])
            columns = np.unique(items.term[span])
            owner = np.repeat(np.arange(part.stop - part.start), np.diff(items.bounds[part.start : part.stop + 1]))
            value = weight[items.term[span]] * items.times[span]
            most = np.bincount(owner, value.astype(float), part.stop - part.start).max(initial=0) * 1e6
            kind = np.float64 if most < EXACT else np.int64
            matrix = _dense(part.stop - part.start, len(columns), owner, np.searchsorted(columns, items.term[span]), value, kind)
            local = np.full(len(items.vocabulary), -1, np.int64)
            local[columns] = np.arange(len(columns))
            made.append((part, local, columns, Tree.over(matrix, np.ones(len(columns), kind)), Best(part.stop - part.start, k), kind))
        for batch in batches:
            for block in range(batch.num_rows):
                ids, present, lengths, row, term, times = (np.frombuffer(batch[c][block].as_buffer() or b"", t) for c, t in (("ids", "<i8"), ("present", "u1"), ("lengths", "<i8"), ("row", "<i4"), ("term", "<i4"), ("times", "<i4")))
                impact = impacts(times, lengths[row], n, total)
                for _, local, columns, tree, best, kind in made:
                    step = int(min(DOCS, max(1, CELLS // max(1, len(columns)))))
                    mine = local[term] >= 0
                    r, c, v = row[mine], local[term[mine]], impact[mine]
                    for low in range(0, len(ids), step):
                        high = min(low + step, len(ids))
                        s = slice(*np.searchsorted(r, [low, high]))
                        if s.start == s.stop:
                            continue
                        some, place = np.unique(r[s], return_inverse=True)  # documents with a term
                        docs = Tree.over(_dense(len(some), len(columns), place, c[s], v[s], kind), weight[columns].astype(kind))
                        search(tree, docs, best, ids[some], present[some] == 0)
        for part, _, _, _, best, _ in made:
            rows = np.repeat(np.arange(len(best.n)), best.n)
            at = np.concatenate([np.zeros(0, np.int64), *[np.arange(x) for x in best.n]])
            numbers = items.numbers[part][rows]
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(best.id[rows, at], mask=best.absent[rows, at]), pa.array(best.score[rows, at])], ["item", "doc_id", "score"])

    return run, "item long, doc_id long, score long"


def ranked_search(items: DataFrame, documents: DataFrame, k: int = TOP, item_id_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ``k`` documents of highest score above 0.

    Terms are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII, taken from whole texts; they are
    compared by 64-bit hashes. Null, empty and blank texts have no terms: such documents count for nothing, such items
    have no rows. Equal scores go by ascending id, rows without id last; repeated rows are documents of their own, and
    so are repeated items, each with ranks of its own. Empty tables give no rows; other columns are not read.
    """
    spark = documents.sparkSession
    texts.small_batches(spark)
    folder, groups, names = numbered_items(items, item_id_col, item_text_col)
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for number in range(groups):
        blocks = store.stored(docs.mapInArrow(*_indexed(folder, number)), "blocks")
        n, total = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        counts = blocks.select(F.explode(F.arrays_zip("held", "df")).alias("x")).groupBy("x.held").agg(F.sum("x.df").alias("df")).toPandas()  # terms of the group
        df = np.zeros(0 if counts.empty else int(counts["held"].max()) + 1, np.int64)
        df[counts["held"].to_numpy(np.int64)] = counts["df"].to_numpy(np.int64)
        found = found.unionByName(store.stored(blocks.mapInArrow(*_searched(folder, number, k, n, total, df)), "found"))
        store.dropped(spark, blocks)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(names, "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked_search(benchmark, documents).select(F.col("item_id"), "rank", "doc_id", "score")
