"""Merkle manifest of a dataset by bitmap ranks.

The ids of every group are merged into a sparse bitmap: one row for each 64-bit word that is not empty, made by
``bit_or`` with map-side sums. A directory of counts over it, in steps of at most 16 bits of the id, says how many
ids lie before a word, so the rank of an id, the coordinate of its leaf, is a directory entry and a popcount: leaves
are not sorted, and no window of the directory has more than 65,536 rows whatever the ids are. Leaves then go to slot
arrays, keyed by group and coordinate without its last ``SLOT_BITS`` bits; each array is reduced by that many levels
at once and leaves one node for the arrays of the next round. A group is never in one place, and its arrays are bounded.
Paths come back down the same way: an array adds its own siblings to the path of its node.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm import store

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SLOT_BITS = 8
WORD_BITS = 6
CHUNK = 4096  # copies of one leaf that are dealt out together
_NO_WORD = -(1 << 63)  # before every word of an id


def digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    parts = []
    for c in fields:
        value = c.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(documents: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS, changed: Mapping[str, Column] | None = None) -> DataFrame:
    """``g`` (the group, null before all others), ``id``, ``leaf`` and ``seen``, the leaf of the row as ``changed``
    shows it, null where nothing is changed."""
    now = {c: F.col(f"`{c}`") for c in fields}
    later = now | dict(changed or {})
    same = reduce(lambda a, b: a & b, [now[c].eqNullSafe(later[c]) for c in changed or ()], F.lit(True))
    group = F.col(f"`{group_col}`").cast("string")
    return documents.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        digest([now[c] for c in fields]).alias("leaf"),
        F.when(~same, digest([later[c] for c in fields])).alias("seen"),
    )


def counted_before(rows: DataFrame, by: list[str], key: str, shifts: Sequence[int]) -> DataFrame:
    """The rows, one for each ``by`` and ``key``, with ``base``, the sum of ``n`` over smaller keys, and ``total``, over all.

    The key is cut into steps: each entry of the directory counts what lies before it below the same next step,
    so a window has as many rows as a step has values.
    """
    steps = [key] + [f"step{k}" for k in range(len(shifts))]
    tables = [rows.select(*by, key, "n").withColumn(steps[1], F.shiftright(key, shifts[0]))]
    for k in range(1, len(steps)):
        upper = tables[-1].groupBy(*by, steps[k]).agg(F.sum("n").alias("n"))
        if k < len(shifts):
            upper = upper.withColumn(steps[k + 1], F.shiftright(steps[k], shifts[k] - shifts[k - 1]))
        tables.append(upper)
    last = Window.partitionBy(*by)
    found = tables[-1].select(*by, steps[-1], (F.sum("n").over(last.orderBy(steps[-1])) - F.col("n")).alias("base"), F.sum("n").over(last).alias("total"))
    for k in range(len(steps) - 2, -1, -1):
        cell = [*by, steps[k + 1]]
        inside = F.sum("n").over(Window.partitionBy(*cell).orderBy(steps[k])) - F.col("n")
        found = tables[k].withColumn("inside", inside).join(found, cell).select(*by, steps[k], (F.col("base") + F.col("inside")).alias("base"), "total")
    return rows.join(found, [*by, key])


def bitmap(rows: DataFrame) -> DataFrame:
    """The groups' bitmaps: ``word``, its ``bits``, ``n`` rows in it and ``base`` rows of the group before it; ``total`` in the group.

    Rows without id are a word of their own before all others, without bits.
    """
    words = rows.groupBy("g", _word().alias("word")).agg(F.bit_or(_bit()).alias("bits"), F.count(F.lit(1)).alias("n"))
    return counted_before(words, ["g"], "word", (10, 26, 42))


def _bit() -> Column:
    """The id's bit of its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(63).cast("int"))


def _word() -> Column:
    return F.coalesce(F.shiftright("id", WORD_BITS), F.lit(_NO_WORD))


def coordinates(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``g``, ``at`` (the leaf's place in its group), ``total``, ``id``, ``leaf`` and ``seen`` of every row.

    Where a word has as many rows as bits, the place is its base and the bits before the id. Rows that share an id
    come in the order of their leaves: counted by leaf first, so copies of one row are one row here, and ranked
    by the first bytes of the leaf as ids are.
    """
    unique = F.coalesce(F.bit_count("bits") == F.col("n"), F.lit(False))
    joined = rows.withColumn("word", _word()).join(words, ["g", "word"])
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("id").bitwiseAND(63).cast("int")))
    out = ["g", "at", "total", "id", "leaf", "seen"]
    plain = joined.where(unique).withColumn("at", F.col("base") + F.bit_count(F.col("bits").bitwiseAND(below))).select(*out)
    if words.where(~unique).isEmpty():
        return plain
    spark = rows.sparkSession
    some = joined.where(~unique).withColumn("key", F.coalesce("id", F.lit(_NO_WORD))).groupBy("g", "word", "key", "leaf")
    some = some.agg(F.first("base").alias("base"), F.first("total").alias("total"), F.first("id").alias("id"), F.first("seen").alias("seen"), F.count(F.lit(1)).alias("n"))
    some = store.stored(some.withColumn("head", F.conv(F.hex(F.substring("leaf", 1, 7)), 16, 10).cast("long")), "same-ids")
    ids = some.groupBy("g", "word", "key").agg(F.sum("n").alias("n"))
    ids = ids.select("g", "word", "key", (F.sum("n").over(Window.partitionBy("g", "word").orderBy("key")) - F.col("n")).alias("smaller"))
    heads = counted_before(some.groupBy("g", "word", "key", "head").agg(F.sum("n").alias("n")), ["g", "word", "key"], "head", (8, 24, 40)).select("g", "word", "key", "head", F.col("base").alias("before"))
    tie = F.sum("n").over(Window.partitionBy("g", "word", "key", "head").orderBy("leaf")) - F.col("n")
    some = some.withColumn("tie", tie).join(ids, ["g", "word", "key"]).join(heads, ["g", "word", "key", "head"])
    some = some.withColumn("at", F.col("base") + F.col("smaller") + F.col("before") + F.col("tie"))
    chunks = some.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    chunks = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    copies = chunks.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + CHUNK - 1, F.col("n") - 1))))
    return plain.unionByName(copies.withColumn("at", F.col("at") + F.col("copy")).select(*out))


def slot_arrays(nodes: DataFrame, *more: str) -> DataFrame:
    """Arrays of nodes, ``slots``, by group and ``block``, their coordinate without its last bits."""
    slot = F.struct(F.col("at").bitwiseAND((1 << SLOT_BITS) - 1).cast("int").alias("at"), "node", *more)
    return nodes.groupBy("g", F.shiftright("at", SLOT_BITS).alias("block")).agg(F.first("total").alias("total"), F.collect_list(slot).alias("slots"))


def _levels(total: int, done: int) -> int:
    """Levels that a group of so many leaves has left for a round, of which ``done`` have been built."""
    return max(0, min(SLOT_BITS, (total - 1).bit_length() - done))


def _rows(batch: pa.RecordBatch, *fields: str):
    """Index, levels-relevant total and the slots' values in order of ``at``, for each row of a batch."""
    for k, (total, slots) in enumerate(zip(batch["total"].to_pylist(), batch["slots"])):
        held = slots.values
        by = [held.field(f).to_pylist() for f in ("at", *fields)]
        order = sorted(range(len(held)), key=by[0].__getitem__)
        yield k, total, [[column[i] for i in order] for column in by]


def _up(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """Hex nodes level by level, the given ones first."""
    out = [nodes]
    for _ in range(levels):
        now = out[-1]
        out.append([sha256(b"".join(now[i : i + 2])).hexdigest().encode() for i in range(0, len(now), 2)])
    return out


def _siblings(tree: list[list[bytes]], place: int) -> bytes:
    """The siblings of a node up to the top: a byte for the side, 0 where there is none, and 64 of the digest."""
    out = []
    for level in tree[:-1]:
        other = place ^ 1
        out.append(b"0" if other >= len(level) else (b"L" if other < place else b"R") + level[other])
        place >>= 1
    return b"".join(out)


def _reduced(done: int):
    def run(batches):
        for batch in batches:
            made = [_up([x.hex().encode() for x in nodes], _levels(total, done))[-1][0] for _, total, (_, nodes) in _rows(batch, "node")]
            yield pa.RecordBatch.from_arrays([batch["g"], batch["block"], batch["total"], pa.array([bytes.fromhex(x.decode()) for x in made], pa.binary())], ["g", "at", "total", "node"])

    return run, "g string, at long, total long, node binary"


def _paths(done: int, named: bool):
    """One row a slot with its path; the slots of the tree over the groups are ``named`` by group."""

    def run(batches):
        for batch in batches:
            keep, group, place, path, own = [], [], [], [], []
            above, blocks = batch["path"].to_pylist(), batch["block"].to_pylist()
            for k, total, (at, nodes, *names) in _rows(batch, "node", *(["name"] if named else [])):
                tree = _up([x.hex().encode() for x in nodes], _levels(total, done))
                for i in range(len(at)):
                    keep.append(k)
                    path.append(_siblings(tree, i) + above[k])
                    own.append(nodes[i].hex())
                    place.append(0 if named else (blocks[k] << SLOT_BITS) + at[i])
                group += names[0] if named else []
            of = pa.array(keep, pa.int64())
            subroot = pa.array(own, pa.string()) if named else batch["subroot"].take(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group, pa.string()) if named else batch["g"].take(of), pa.array(place, pa.int64()), pa.array(path, pa.binary()), subroot, batch["root"].take(of)], ["g", "block", "path", "subroot", "root"]
            )

    return run, "g string, block long, path binary, subroot string, root string"


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root (hex) that a leaf (hex) and its path lead to."""
    at = 0
    while at < len(path):
        side, other = path[at : at + 1], path[at + 1 : at + 65]
        leaf = sha256(leaf if side == b"0" else other + leaf if side == b"L" else leaf + other).hexdigest().encode()
        at += 1 if side == b"0" else 65
    return leaf


def siblings(path: bytes) -> bytes:
    """The digests of a path, one after the other."""
    out, at = [], 0
    while at < len(path):
        out.append(path[at + 1 : at + 65] if path[at : at + 1] != b"0" else b"")
        at += 1 if path[at : at + 1] == b"0" else 65
    return b"".join(out)


def _proofs(batches):
    for batch in batches:
        keep, rows = [], []
        above, roots = batch["path"].to_pylist(), batch["root"].to_pylist()
        for k, total, (_, nodes, ids, seen) in _rows(batch, "node", "id", "seen"):
            hexes = [x.hex().encode() for x in nodes]
            tree = _up(hexes, _levels(total, 0))
            for i, leaf in enumerate(hexes):
                path = _siblings(tree, i) + above[k]
                folded = fold(seen[i].hex().encode() if seen[i] is not None else leaf, path).decode()
                keep.append(k)
                rows.append((ids[i], leaf.decode(), path, sha256(siblings(path)).hexdigest(), folded, folded == roots[k]))
        of = pa.array(keep, pa.int64())
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.bool_()]
        own = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([own[0], batch["g"].take(of), *own[1:3], batch["subroot"].take(of), batch["root"].take(of), *own[3:]], ["id", "g", "leaf", "path", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """The rows with ``at``, their place in the order of ``key``: range partitions and sums over their counts."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), key).sortWithinPartitions(key)
    serial = F.monotonically_increasing_id()
    placed = store.stored(placed.withColumn("part", F.shiftright(serial, 33)).withColumn("place", serial.bitwiseAND((1 << 33) - 1)), "numbered")
    counts, base, before = sorted((r.part, r["count"]) for r in placed.groupBy("part").count().collect()), [], 0  # one row a partition
    for part, n in counts:
        base.append((part, before))
        before += n
    bases = spark.createDataFrame(base, "part long, base long")
    return placed.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("place")).withColumn("total", F.lit(before).cast("long")).drop("part", "place", "base")


def _built(arrays: DataFrame, rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of every round and the last round's nodes."""
    levels = [arrays]
    while True:
        nodes = levels[-1].mapInArrow(*_reduced(SLOT_BITS * (len(levels) - 1)))
        if len(levels) >= rounds:
            return levels, store.stored(nodes, "nodes")
        levels.append(store.stored(slot_arrays(nodes), "slots"))


def _rounds(largest: int) -> int:
    return max(1, -(-(largest - 1).bit_length() // SLOT_BITS))


@dataclass
class Manifest:
    """Stored slot arrays of each round, of the groups' trees and of the tree over them, and the root."""

    spark: SparkSession
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    def proofs(self) -> DataFrame:
        """Per leaf ``id``, ``g`` (null: empty, else ``=`` and the group), ``leaf``, ``path``, ``subroot``, ``root``,
        ``proof_sha256``, ``folded_root`` (from the leaf as it was seen) and ``verified``."""
        schema = "id long, g string, leaf string, path binary, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        if self.root is None:
            return self.spark.createDataFrame([], schema)
        paths = self.spark.createDataFrame([("", 0, b"", "", self.root)], "g string, block long, path binary, subroot string, root string")
        for k in reversed(range(len(self.top))):
            paths = self.top[k].join(paths, ["g", "block"]).mapInArrow(*_paths(SLOT_BITS * k, k == 0))
        for k in reversed(range(1, len(self.levels))):
            paths = self.levels[k].join(paths, ["g", "block"]).mapInArrow(*_paths(SLOT_BITS * k, False))
        return self.levels[0].join(paths, ["g", "block"]).mapInArrow(_proofs, schema)


def build_manifest(documents: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS, changed: Mapping[str, Column] | None = None) -> Manifest:
    """Make each row a leaf, each group a tree over its leaves by ascending id, and a tree over the groups' roots.

    ``changed`` maps fields to what they are when the leaves are seen again; proofs fold that. Null fields are ``-``;
    a null group is a group before all others; rows without id come first in their group, rows that share an id in
    the order of their leaves, and repeated rows are leaves as often as they are. Empty and very long texts are
    values like others. An empty table has no root and no proofs. Columns that are not fields are not read.
    """
    spark = documents.sparkSession
    rows = store.stored(leaves(documents, id_col, group_col, fields, changed), "leaves")
    words = store.stored(bitmap(rows), "bitmap")
    largest = words.agg(F.max("total")).first()[0]
    if largest is None:
        return Manifest(spark, [], [], None)
    arrays = store.stored(slot_arrays(coordinates(rows, words).withColumnRenamed("leaf", "node"), "id", "seen"), "slots")
    levels, subroots = _built(arrays, _rounds(largest))
    groups = numbered(subroots.select(F.col("g").alias("name"), "node"), "name").withColumn("g", F.lit(""))
    held = store.stored(slot_arrays(groups, "name"), "slots")
    top, root = _built(held, _rounds(held.agg(F.max("total")).first()[0]))
    store.dropped(spark, rows, words)
    return Manifest(spark, levels, top, root.first()["node"].hex())


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    proofs = build_manifest(documents, changed=changed).proofs()
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
