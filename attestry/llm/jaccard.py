"""N-gram Jaccard join by token-combination prefixes.

A document is its set of distinct word shingles ("tokens", as 64-bit hashes). All sets share one order: rare
tokens first, then frequent ones by count. If two sets are similar enough, all but a few tokens of either
are shared, so a long enough prefix of both in that order has shared tokens. Rare tokens are indexed one by
one. Frequent ones fall into partitions, and pairs of tokens of a partition are indexed instead; as one
shared token of a partition then goes unseen, the prefix is extended by one for every partition it touches.
Which tokens count as frequent, and the partition of a token, are the same for all documents, so no link is
lost whatever the counts are; they only decide how small the index groups stay.

Groups of one index key are never multiplied out. Their members are first held against the group's smallest
member and the one before (rows in proportion to the index), verified, and joined to components. Only members
of groups that still hold several components are then compared with each other, in tiles, by a parity bitmap
that bounds the difference of two sets from below; what the bitmap can't reject is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm import store, texts
from attestry.llm.components import components

WORDS = 5
PERCENT = 80
FREQUENT_FROM = 32
FREQUENT_MOST = 1 << 20  # bound of the table of frequent tokens that tasks get: 16 MB
CHUNK = 1 << 21
TILE = 1024
_ODD = np.uint64(0xD6E8FEB86659FD93)


def token_sets(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct tokens in ascending order, and its first one."""
    _, _, hashes, bounds = texts.words(texts.LOWER[raw], at, texts.SPACED_WORD)
    return texts.distinct_sorted(*texts.shingles(hashes, bounds, size))


def set_hashes(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash for each set: equal sets are one node of the join."""
    return texts.mix(texts.sums(texts.mix(tokens * _ODD), bounds) + np.diff(bounds).astype(np.uint64))


def _levels(n: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap, as a power of two: four a token, 256 at least."""
    return np.maximum(np.ceil(np.log2(np.maximum(n, 1) * 4)), 8).astype(np.int64)


def bitmaps(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity bitmaps: bit i is set if an odd number of tokens falls on it."""
    n = np.diff(bounds)
    level = _levels(n)
    out: list[bytes] = [b""] * len(n)
    for lv in np.unique(level[n > 0]):
        docs = np.flatnonzero((level == lv) & (n > 0))
        width = 1 << int(lv)
        for part in np.array_split(docs, max(1, len(docs) * width >> 23)):
            member = np.concatenate([tokens[bounds[d] : bounds[d + 1]] for d in part])
            row = np.repeat(np.arange(len(part)), n[part])
            bit = (member & np.uint64(width - 1)).astype(np.int64)
            odd = np.bincount(row * width + bit, minlength=len(part) * width).astype(np.uint8) & 1
            packed = np.packbits(odd.reshape(len(part), width), axis=1, bitorder="little")
            for d, bits in zip(part, packed):
                out[d] = bits.tobytes()
    return out


def may_link(sketches: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (a, b) of sets their sizes and bitmaps can't reject."""
    keep = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
    pairs = np.flatnonzero(keep)
    level = _levels(n)
    total = n[a] + n[b]
    most = total - 2 * -(-percent * total // (100 + percent))  # tokens that only one of two linked sets has
    at = np.minimum(level[a], level[b])
    for lv in np.unique(at[pairs]):
        chosen = pairs[at[pairs] == lv]
        used = np.unique(np.concatenate([a[chosen], b[chosen]]))
        rows = np.zeros((len(used), 1 << (int(lv) - 6)), np.uint64)
        for k, i in enumerate(used):
            bits = np.frombuffer(sketches[i], np.uint64)
            while len(bits) > rows.shape[1]:  # half the width: the halves' parities add up
                bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
            rows[k] = bits
        x, y = np.searchsorted(used, a[chosen]), np.searchsorted(used, b[chosen])
        step = max(1, (1 << 20) // rows.shape[1])
        for low in range(0, len(chosen), step):
            c = chosen[low : low + step]
            differ = np.bitwise_count(rows[x[low : low + step]] ^ rows[y[low : low + step]]).sum(1, dtype=np.int64)
            keep[c[differ > most[c]]] = False
    return keep


def prefix_signatures(tokens: np.ndarray, bounds: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of each set and the set they belong to."""
    n = np.diff(bounds)
    least = -(-percent * n // 100)  # tokens that any linked set shares
    spare = n - least
    owner = texts.owners(bounds)
    known, counts = frequent
    if len(known):
        slot = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        often = np.where(known[slot] == tokens, counts[slot], 0)
    else:
        often = np.zeros(len(tokens), np.int64)
    order = np.argsort((owner << 32) | np.minimum(often, (1 << 32) - 1), kind="stable")
    tokens, often = tokens[order], often[order]
    rare = often == 0
    single = rare & (np.arange(len(tokens)) - bounds[owner] <= spare[owner])
    keys, of = [tokens[single]], [owner[single]]
    n_rare = texts.sums(rare, bounds)
    more = n_rare <= spare  # the prefix of these goes on into frequent tokens
    parts = lambda size: np.maximum(1, 1 << np.maximum(0, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) - 4))
    own, lower = parts(n), parts(least)
    for number, docs in ((own, more), (lower, more & (lower != own))):
        i = np.flatnonzero(docs[owner] & ~rare)
        if not len(i):
            continue
        t, o = tokens[i], owner[i]
        part = (t >> np.uint64(24)).astype(np.int64) & (number[o] - 1)
        group = np.unique(o * (1 << 40) + part, return_index=True)[1]
        gain = np.ones(len(i), np.int64)
        gain[group] = 0  # the first token of a partition makes no pair
        first = np.searchsorted(o, np.arange(len(n) + 1))
        before = np.cumsum(gain) - gain
        score = n_rare[o] + before - before[np.minimum(first[o], len(i) - 1)]
        inside = score <= spare[o]
        t, o, part = t[inside], o[inside], part[inside]
        by = np.lexsort((t, part, o))
        t, o, part = t[by], o[by], part[by]
        for d in range(1, len(t)):
            same = (o[d:] == o[:-d]) & (part[d:] == part[:-d])
            if not same.any():
                break
            j = np.flatnonzero(same)
            keys.append(texts.mix(t[j] * _ODD + texts.mix(t[j + d]) + number[o[j]].astype(np.uint64)))
            of.append(o[j])
    return np.concatenate(keys), np.concatenate(of)


def _bytes(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [tokens[bounds[d] : bounds[d + 1]].tobytes() for d in range(len(bounds) - 1)]


def _summaries(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, count = [], set(), 0

        def common() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            values, times = values[times > 1], times[times > 1]
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(values), pa.binary()), pa.array(texts.signed(values)), pa.array(times)], NAMES)

        for batch in batches:
            for low, high, raw, at in texts.blocks(batch["text"]):
                tokens, bounds = token_sets(raw, at, size)
                nodes = set_hashes(tokens, bounds)
                none = pa.nulls(high - low, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(low, high - low), batch["text_key"].slice(low, high - low), pa.array(np.diff(bounds)), pa.array(texts.signed(nodes)), pa.array(bitmaps(tokens, bounds), pa.binary()), none, none],
                    NAMES,
                )
                fresh = [d for d, node in enumerate(nodes.tolist()) if node not in seen and not seen.add(node)]
                held.extend(tokens[bounds[d] : bounds[d + 1]] for d in fresh)
                count += sum(bounds[d + 1] - bounds[d] for d in fresh)
                if count > CHUNK:
                    yield common()
                    held, seen, count = [], set(), 0
        yield common()

    NAMES = ["id", "text_key", "n", "node", "sketch", "token", "times"]
    return run, "id long, text_key long, n long, node long, sketch binary, token long, times long"


def _signatures(size: int, percent: int, frequent):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for low, high, raw, at in texts.blocks(batch["text"]):
                tokens, bounds = token_sets(raw, at, size)
                nodes, n = set_hashes(tokens, bounds), np.diff(bounds)
                keys, of = prefix_signatures(tokens, bounds, frequent.value, percent)
                fresh = np.array([node not in seen and not seen.add(node) for node in nodes.tolist()], bool)
                if len(seen) > 1 << 18:
                    seen = set()
                take = fresh[of]
                keys, of = keys[take], of[take]
                yield pa.RecordBatch.from_arrays([pa.array(texts.signed(keys)), pa.array(texts.signed(nodes[of])), pa.array(n[of], pa.int32())], ["key", "node", "n"])

    return run, "key long, node long, n int"


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for _, _, raw, at in texts.blocks(batch["text"]):
                tokens, bounds = token_sets(raw, at, size)
                yield pa.RecordBatch.from_arrays([pa.array(texts.signed(set_hashes(tokens, bounds))), pa.array(_bytes(tokens, bounds), pa.binary())], ["node", "tokens"])

    return run, "node long, tokens binary"


def _screen(percent: int):
    def run(batches):
        for batch in batches:
            r = batch.num_rows
            n = np.concatenate([batch["n_a"].to_numpy(), batch["n_b"].to_numpy()]).astype(np.int64)
            keep = may_link(batch["sketch_a"].to_pylist() + batch["sketch_b"].to_pylist(), n, np.arange(r), np.arange(r) + r, percent)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep))

    return run, "a long, b long"


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["tokens_a"], batch["tokens_b"]):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run, "a long, b long"


def _tiles(percent: int):
    """Pairs across components inside each tile; rows of a tile come one after another."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        node, label, n = (rows[c].to_numpy() for c in ("node", "label", "n"))
        n = n.astype(np.int64)
        left, side = rows["left"].to_numpy(), rows["right"].to_numpy()
        a, b = np.triu_indices(len(node), 1)
        tile = rows["tile"].to_numpy()
        fit = (label[a] != label[b]) & ((left[0] == side[0]) | (tile[a] != tile[b]))
        a, b = a[fit], b[fit]
        keep = may_link(rows["sketch"].to_pylist(), n, a, b, percent)
        a, b = a[keep], b[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["a", "b"])

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = [table[c].to_numpy() for c in ("hub", "left", "right")]
            change = np.zeros(len(table) + 1, bool)
            for k in key:
                change[1:-1] |= k[1:] != k[:-1]
            if held and len(table):
                last = [held[-1][c][-1].as_py() for c in ("hub", "left", "right")]
                change[0] = any(x != k[0] for x, k in zip(last, key))
            low = 0
            for cut in np.flatnonzero(change):
                if cut > low:
                    held.append(table.slice(low, cut - low))
                if held:
                    yield pairs(pa.concat_tables(held).combine_chunks())
                held, low = [], int(cut)
            if low < len(table):
                held.append(table.slice(low))
        if held:
            yield pairs(pa.concat_tables(held).combine_chunks())

    return run, "a long, b long"


def _map(df: DataFrame, made) -> DataFrame:
    return df.mapInArrow(*made)


def similarity_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT, frequent_from: int = FREQUENT_FROM) -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` (smallest id reachable by links) of every document.

    Words are lower-cased (A-Z) runs without ASCII white space. Two documents are linked when
    ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct ``size``-word shingles; with fewer words
    the whole sequence is the one shingle. A null, empty or blank text has no shingle and no link: its
    component is its own id. Equal sets are joined once. A document without id counts for its component and
    has the component's smallest id, null if there is none. Repeated rows give repeated rows. Other columns of
    the input are not read.
    """
    spark = documents.sparkSession
    texts.small_batches(spark)
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    summary = store.stored(_map(docs, _summaries(size)), "summaries")
    common = summary.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= frequent_from)
    common = common.orderBy(F.desc("times"), "token").limit(FREQUENT_MOST).toArrow()
    known = common["token"].to_numpy().view(np.uint64)
    by = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[by], common["times"].to_numpy()[by].astype(np.int64)))

    each = Window.partitionBy("key").orderBy("n", "node")
    index = _map(docs.select("text"), _signatures(size, percent, frequent))
    index = index.select("node", "n", *[f(c).over(each).alias(f"{k}_{c}") for c in ("node", "n") for k, f in (("last", F.lag), ("hub", F.first))])
    index = store.stored(index.where("last_node <> node").drop("key").distinct(), "index")
    summary_nodes = summary.where("token is null").select("id", "text_key", "n", "node", "sketch")

    stars = index.select(F.col("hub_node").alias("hub"), "node").distinct()
    stars = store.stored(stars.unionByName(stars.select("hub", F.col("hub").alias("node")).distinct()), "stars")
    members = stars.select("node").distinct()
    # Copies are summed up before the join, so a set that many documents have is one row in it.
    nodes = summary_nodes.groupBy("node").agg(F.min(F.struct("id", "text_key")).alias("copy"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    nodes = store.stored(nodes.join(members, "node"), "nodes")

    def sided(pairs: DataFrame, table: DataFrame, key: str, *columns: str) -> DataFrame:
        for s in ("a", "b"):
            pairs = pairs.join(table.select(F.col(key).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]), s)
        return pairs

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs that are links, by their whole sets."""
        pairs = store.stored(pairs, "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select(F.col("copy.id").alias("w_id"), F.col("copy.text_key").alias("w_key"))
        wanted = store.stored(wanted, "wanted")
        same = (F.col("text_key") == F.col("w_key")) & F.col("id").eqNullSafe(F.col("w_id"))
        sets = store.stored(_map(docs.join(wanted, same, "left_semi").select("text"), _sets(size)).dropDuplicates(["node"]), "sets")
        links = store.stored(_map(sided(pairs, sets, "node", "tokens"), _verified(percent)), "links")
        store.dropped(spark, sets, wanted, pairs)
        return links

    fits = lambda x, y: F.col(x) * 100 >= F.col(y) * percent
    near = index.where(fits("hub_n", "n")).select(F.col("hub_node").alias("a"), F.col("node").alias("b"))
    near = near.unionByName(index.where(fits("last_n", "n")).select(F.col("last_node").alias("a"), F.col("node").alias("b")))
    near = near.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = verify(_map(sided(near, nodes, "node", "n", "sketch"), _screen(percent)))
    labels = store.stored(components(links), "labels")

    marked = stars.join(labels, "node", "left").select("hub", "node", F.coalesce("label", "node").alias("label"))
    mixed = marked.groupBy("hub").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("m")).where("x <> y")
    mixed = mixed.select("hub", F.ceil(F.col("m") / TILE).cast("int").alias("k"))
    rows = marked.join(mixed, "hub").withColumn("tile", F.pmod(F.xxhash64("node"), "k").cast("int"))
    rows = rows.join(nodes.select("node", "n", "sketch"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("hub", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "tile", "node", "label", "n", "sketch")
    rows = rows.repartition("hub", "left", "right").sortWithinPartitions("hub", "left", "right", "n")
    more = store.stored(_map(rows, _tiles(percent)).distinct(), "across")
    if not more.isEmpty():
        links = verify(more)
        labels = store.stored(components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))), "labels")

    classes = summary_nodes.groupBy("node").agg(F.min("id").alias("least")).join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    lowest = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = classes.join(lowest, "label").select("node", "component_id")
    out = summary_nodes.select("id", "n", "node").join(classes, "node")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component: the one with the smallest id. Repeated rows of an id stay once;
    documents without id stay as they are; columns are those of the input."""
    found = similarity_classes(documents, id_col, text_col, **options)
    chosen = found.where("id = component_id").select(F.col("id").alias("kept_id")).distinct()
    plain, key = store.numbered_columns(documents), f"c{documents.columns.index(id_col)}"
    stay = plain.join(chosen, F.col(key).cast("long") == F.col("kept_id"), "left_semi").dropDuplicates([key])
    return stay.unionByName(plain.where(F.col(key).isNull())).toDF(*documents.columns)


def op4_token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similarity_classes(documents).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
