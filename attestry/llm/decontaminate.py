"""Benchmark decontamination by training suffix arrays.

Every task cuts its documents into blocks (the shards) and sorts all word suffixes of a block. Each suffix
of each benchmark item is then found by binary search, one word deeper at a time, until no training suffix
agrees any more: the depth reached is its longest verbatim match, the remaining range its locations. A range
that reaches a whole window marks the words of its occurrences as hit. Documents never leave their partition,
so there is no shuffle; the benchmark comes to the tasks in blocks of ``ITEM_BYTES``, one pass for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import store, texts

WINDOW = 13
SHARE = 0.05
ITEM_BYTES = 8 << 20
COLUMNS = ("n_words", "n_hit", "longest", "hit_spans", "hit_items", "matches")
_SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
_MATCH = T.ArrayType(
    T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])
)
_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("longest", T.LongType()),
    T.StructField("hit_spans", _SPAN),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("matches", _MATCH),
]


def item_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts, lower-cased, and each text's first word."""
    raw, at = texts.utf8(column)
    _, _, hashes, bounds = texts.words(texts.LOWER[raw], at, texts.ALNUM_WORD)
    return hashes, bounds


def suffix_array(ranks: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Word positions in the order of the suffixes that begin there, down to ``depth`` words at least.

    ``ranks`` are word numbers from 1, ``end`` the end of each position's document; a suffix stops there.
    """
    n = len(ranks)
    at = np.arange(n)

    def word(j: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        near = at + j < end
        out[near] = ranks[at[near] + j]
        return out

    top = int(ranks.max()) + 1 if n else 1
    have = 3 if top < 1 << 21 else 2
    bits = 21 if have == 3 else 31
    key = word(0)
    for j in range(1, have):
        key = (key << bits) | word(j)
    order = np.argsort(key, kind="stable")
    first = np.ones(n, bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)  # from 1: the first place of the suffixes that are equal so far
    rank[order] = np.maximum.accumulate(np.where(first, at, 0)) + 1
    while have < depth:
        tied = ~first
        tied[:-1] |= ~first[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        p = order[slots]
        ahead = np.zeros(len(p), np.int64)
        near = p + have < end[p]
        ahead[near] = rank[p[near] + have]
        sort = np.lexsort((ahead, rank[p]))
        p, ahead = p[sort], ahead[sort]
        group = rank[p]
        new = np.ones(len(p), bool)
        new[1:] = (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])
        order[slots] = p
        first[slots] = new
        rank[p] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        have *= 2
    return order


def _bound(order, ranks, end, low, high, depth, wanted, right: bool) -> np.ndarray:
    """In each range of equal ``depth`` words, the first suffix whose next word isn't less (or is more)."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        p = order[np.where(open_, mid, 0)] + depth
        value = np.where(p < end[np.where(open_, order[np.where(open_, mid, 0)], 0)], ranks[np.minimum(p, len(ranks) - 1)], 0)
        less = (value <= wanted) if right else (value < wanted)
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)


def search(hashes, bounds, item_hashes, item_bounds, window: int):
    """Window hits and longest matches of all item suffixes in the documents of a block.

    Returns (item, first word, words) of every window occurrence and (item, item word, first word, words)
    of every longest match that cannot be extended to the left.
    """
    vocabulary = np.unique(hashes)
    ranks = np.searchsorted(vocabulary, hashes) + 1
    begin, end = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    sizes = np.diff(item_bounds)
    owner = texts.owners(item_bounds)
    n_items = len(item_hashes)
    found = np.searchsorted(vocabulary, item_hashes)
    known = (found < len(vocabulary)) & (vocabulary[np.minimum(found, len(vocabulary) - 1)] == item_hashes)
    wanted = np.where(known, found + 1, -1)
    left = item_bounds[1:][owner] - np.arange(n_items)  # words of each item suffix
    need = np.minimum(sizes[owner], window)
    order = suffix_array(ranks, end, max(int(sizes.max(initial=1)), window))
    low, high = np.zeros(n_items, np.int64), np.full(n_items, len(order), np.int64)
    active, depth = np.arange(n_items), 0
    whole, longest = [], []

    def places(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = high[queries] - low[queries]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        q = np.repeat(queries, count)
        return q, order[low[q] + step]

    def ended(queries: np.ndarray) -> None:
        queries = queries[depth >= need[queries]]
        if len(queries):
            q, p = places(queries)
            start = (q == item_bounds[owner[q]]) | (p == begin[p])
            start |= ranks[p - 1] != wanted[q - 1]
            longest.append((owner[q[start]], q[start] - item_bounds[owner[q[start]]], p[start], np.full(start.sum(), depth)))

    while len(active):
        word = wanted[active + depth]
        a = _bound(order, ranks, end, low[active], high[active], depth, word, False)
        z = _bound(order, ranks, end, a, high[active], depth, word, True)
        alive = (word > 0) & (a < z)
        ended(active[~alive])
        active = active[alive]
        low[active], high[active] = a[alive], z[alive]
        depth += 1
        if len(reached := active[need[active] == depth]):
            q, p = places(reached)
            whole.append((owner[q], p, np.full(len(q), depth)))
        ended(active[left[active] == depth])
        active = active[left[active] > depth]
    join = lambda parts, n: [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * n
    return join(whole, 3), join(longest, 4)


def _ranges(mark: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last word of each run of marked words."""
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(mark))]
    cuts = np.unique(cuts[mark[cuts - 1] & mark[cuts]])
    start, stop = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([stop, cuts]))
    doc = np.searchsorted(bounds, start, "right") - 1
    return doc, start - bounds[doc], stop - bounds[doc] - 1


def _lists(doc: np.ndarray, n: int, columns: dict[str, pa.Array]) -> pa.Array:
    """Rows in document order as one list of structs a document."""
    values = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), values)


def _tables(raw, at, items, window: int, before: pa.Table | None) -> pa.Table:
    """The output columns of one block of documents."""
    names, item_hashes, item_bounds = items
    n = len(at) - 1
    _, _, hashes, bounds = texts.words(texts.LOWER[raw], at, texts.ALNUM_WORD)
    (wi, wp, wn), (mi, mq, mp, mn) = search(hashes, bounds, item_hashes, item_bounds, window) if len(hashes) else ([np.zeros(0, np.int64)] * 3, [np.zeros(0, np.int64)] * 4)
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, wp, 1)
    np.add.at(change, wp + wn, -1)
    hit_doc = np.searchsorted(bounds, wp, "right") - 1
    pairs = {(int(d), names[i]) for d, i in set(zip(hit_doc.tolist(), wi.tolist())) if names[i] is not None}
    doc = np.searchsorted(bounds, mp, "right") - 1
    rows = list(zip(doc.tolist(), [names[i] for i in mi], mq.tolist(), (mp - bounds[doc]).tolist(), mn.tolist()))
    if before is not None:  # what earlier blocks of the benchmark have found
        for d, (spans, items_, matched) in enumerate(zip(*(before[c].to_pylist() for c in COLUMNS[3:]))):
            for s in spans:
                change[bounds[d] + s["first"]] += 1
                change[bounds[d] + s["last"] + 1] -= 1
            pairs.update((d, i) for i in items_)
            rows.extend((d, m["item_id"], m["item_word"], m["word"], m["n"]) for m in matched)
    mark = np.cumsum(change[:-1]) > 0
    span_doc, first, last = _ranges(mark, bounds)
    ordered = sorted(pairs)
    rows.sort(key=lambda r: (r[0], r[3], r[1] or "", r[2]))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, np.array([r[0] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64))
    items_at = np.searchsorted(np.array([d for d, _ in ordered], np.int64), np.arange(n + 1))
    return pa.table(
        {
            "n_words": np.diff(bounds),
            "n_hit": texts.sums(mark, bounds),
            "longest": longest,
            "hit_spans": _lists(span_doc, n, {"first": pa.array(first, pa.int64()), "last": pa.array(last, pa.int64())}),
            "hit_items": pa.ListArray.from_arrays(pa.array(items_at, pa.int32()), pa.array([i for _, i in ordered], pa.string())),
            "matches": _lists(
                np.array([r[0] for r in rows], np.int64),
                n,
                {"item_id": pa.array([r[1] for r in rows], pa.string())} | {k: pa.array([r[j] for r in rows], pa.int64()) for j, k in ((2, "item_word"), (3, "word"), (4, "n"))},
            ),
        }
    )


def _item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple]:
    """The benchmark's items in blocks of at most ``ITEM_BYTES`` (or one item)."""
    names, held, size = [], [], 0
    chosen = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    for row in chosen.toLocalIterator():
        if held and size + len(row.t) > ITEM_BYTES:
            yield names, *item_words(pa.array(held))
            names, held, size = [], [], 0
        names.append(row.i)
        held.append(row.t)
        size += len(row.t)
    yield names, *item_words(pa.array(held, pa.string()))


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: float = SHARE,
) -> DataFrame:
    """All documents with what the benchmark has in common with them.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, ASCII lower-cased. A window is
    ``window`` consecutive words of an item; an item of fewer words is one window. Adds ``n_words``, ``n_hit``
    (words inside occurrences of windows), ``longest`` (words of the longest match of a window or more),
    ``hit_spans`` (word ranges), ``hit_items`` (ids as sorted strings), ``matches`` (item, item word, word,
    length of each longest match that the left can't extend) and ``contaminated``: ``n_hit`` is at least
    ``share`` of the words and above zero.

    A null or empty text has no words and no hits; null or empty items match nothing; an item without id
    counts for hits but is not listed. Repeated documents are judged each by itself, repeated items listed
    once. Columns of the documents named like an output column give way to it.
    """
    spark = documents.sparkSession
    texts.small_batches(spark)
    kept = store.without(documents, *COLUMNS, "contaminated")
    out = kept
    for k, block in enumerate(_item_blocks(benchmark, item_id, item_text)):
        items = spark.sparkContext.broadcast(block)
        later = k > 0

        def run(batches, items=items, later=later):
            for batch in batches:
                table = pa.Table.from_batches([batch])
                base = table.select([c for c in table.column_names if c not in COLUMNS]) if later else table
                for low, high, raw, at in texts.blocks(table[text]):
                    made = _tables(raw, at, items.value, window, table.slice(low, high - low) if later else None)
                    part = base.slice(low, high - low)
                    for name in made.column_names:
                        part = part.append_column(name, made[name])
                    yield from part.to_batches()

        out = out.mapInArrow(run, T.StructType([*kept.schema.fields, *_FIELDS]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= share * F.col("n_words")))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns only, whatever these are called; the same cases as above."""
    plain = store.numbered_columns(documents)
    marked = find_contamination(plain, benchmark, f"c{documents.columns.index(text)}", **options)
    return marked.where(~F.col("contaminated")).select(*plain.columns).toDF(*documents.columns)


def op10_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(documents, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "longest",
    )
