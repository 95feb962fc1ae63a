"""A stored n-gram index: which texts have every three characters, and how many.

Texts are numbered once, two to the power ``BLOCK`` to a block. A row of the gram table is one gram with some texts of
one block that have it, as the gaps between their numbers. Every task lays its own texts out in order of grams, so the
index is written where it is made, without a shuffle, and a reader that wants few grams reads few pages of each file.
Grams are exact numbers made of three code points, two blanks of code point 0 stand behind every text, and a needle of
one or two characters is a range of grams. The index finds the texts that can hold a needle by the rarest of its grams;
these texts are then searched for it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.session import BROADCAST_ROWS, cut_lineage, small

GRAM = 3
BITS = 21  # of a code point
BLOCK = 14  # bits of a text's number inside its block
SLICE = 1 << 21  # characters that are sorted at a time
RANGES = 64  # of grams that a filter names
PRUNE_AT_MOST = 10_000  # distinct grams for which ranges are made; beyond, the join alone selects
_SCHEMA = "gram long, block long, found int, gaps array<int>"


@dataclass(frozen=True)
class GramIndex:
    """``units`` (serial, hay and the texts' own columns), ``grams`` by block, ``frequencies`` (gram, found)."""

    units: DataFrame
    grams: DataFrame
    frequencies: DataFrame


def _texts_of_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of up to ``SLICE`` characters, or one text, of one block."""
    block, items, texts, size = None, [], [], 0
    for batch in batches:
        for serial, text in zip(batch["serial"].to_pylist(), batch["hay"].fill_null("").to_pylist()):
            if texts and (serial >> BLOCK != block or size + len(text) > SLICE):
                yield _sorted(block, np.array(items, np.int32), texts)
                items, texts, size = [], [], 0
            block = serial >> BLOCK
            items.append(serial & ((1 << BLOCK) - 1))
            texts.append(text)
            size += len(text)
    if texts:
        yield _sorted(block, np.array(items, np.int32), texts)


def _sorted(block: int, items: np.ndarray, texts: list[str]) -> pa.RecordBatch:
    ascending = np.argsort(items, kind="stable")
    items, texts = items[ascending], [texts[k] for k in ascending]
    points = np.frombuffer("".join(t + "\0\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    length = np.array([len(t) for t in texts])
    begin = np.cumsum(length + 2) - length - 2
    of = np.repeat(np.arange(len(texts), dtype=np.int32), length)
    at = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
    gram = points[at] << (2 * BITS) | points[at + 1] << BITS | points[at + 2] if len(at) else np.zeros(0, np.int64)
    order = np.argsort(gram, kind="stable")
    gram, of = gram[order], of[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
    gram, item = gram[new], items[of[new]]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    gaps = np.diff(item, prepend=np.int32(0)).astype(np.int32)
    gaps[first] = item[first]
    offsets = np.concatenate([first, [len(gram)]]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(gaps))
    return pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(np.full(len(first), block)), pa.array(np.diff(offsets)), lists], [c.split()[0] for c in _SCHEMA.split(", ")])


def _serials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(needle, block, gaps) as (needle, serial)."""
    for batch in batches:
        lists = batch["gaps"]
        gaps = lists.flatten().to_numpy().astype(np.int64)
        length = np.diff(lists.offsets.to_numpy())
        total = np.concatenate([[0], np.cumsum(gaps)])
        end = np.cumsum(length)
        item = total[1:] - np.repeat(total[end - length], length)
        of = np.repeat(np.arange(len(batch)), length)
        serial = (batch["block"].to_numpy()[of] << BLOCK) + item
        yield pa.RecordBatch.from_arrays([batch["needle"].take(pa.array(of)), pa.array(serial)], ["needle", "serial"])


def build_grams(texts: DataFrame, hay: Column, folder: str | None = None, *drop: str) -> GramIndex:
    """Index the texts; the frame's own columns, but for those to ``drop``, are what hits can carry.

    With a folder the tables are written there: units, grams, frequencies. Without one they are checkpointed. A stored
    frame with a ``serial`` column is the table of units itself, its texts are not written again. Null texts hold nothing.
    """
    spark = texts.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return cut_lineage(df)
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    units = texts.withColumn("hay", hay).drop(*drop)
    if "serial" not in texts.columns:
        units = kept(units.withColumn("serial", F.monotonically_increasing_id()), "units")
    rows = units.select("serial", "hay").mapInArrow(_texts_of_grams, _SCHEMA)
    grams = kept(rows.sortWithinPartitions("gram", "block"), "grams")
    frequencies = kept(grams.groupBy("gram").agg(F.sum("found").alias("found")).repartitionByRange("gram").sortWithinPartitions("gram"), "frequencies")
    return GramIndex(units, grams, frequencies)


def _code(text: Column, at: Column) -> Column:
    """The gram that begins at a 0-based place of the text."""
    point = lambda k: F.ascii(F.substring(text, at + (k + 1), F.lit(1))).cast("long")
    return F.shiftleft(point(0), 2 * BITS).bitwiseOR(F.shiftleft(point(1), BITS)).bitwiseOR(point(2))


def wanted_grams(needles: DataFrame) -> DataFrame:
    """(needle, gram, offset) of needles with three characters or more; a gram that repeats counts at its first place."""
    n = F.length("needle")
    offsets = F.sequence(F.lit(0), n - GRAM)
    return needles.where(n >= GRAM).select("needle", F.explode(offsets).alias("offset")).select("needle", "offset", _code(F.col("needle"), F.col("offset")).alias("gram")).groupBy("needle", "gram").agg(F.min("offset").alias("offset"))


def in_ranges(table: DataFrame, grams: DataFrame) -> DataFrame:
    """The table's rows near the wanted grams, by ranges that reach the scan as filters."""
    values = sorted(r[0] for r in grams.select("gram").distinct().limit(PRUNE_AT_MOST + 1).collect())
    if not values:
        return table.where("false")
    if len(values) > PRUNE_AT_MOST:
        return table
    gaps = sorted(range(1, len(values)), key=lambda k: values[k - 1] - values[k])[: RANGES - 1]
    edges = [0, *sorted(gaps), len(values)]
    held = None
    for low, high in zip(edges, edges[1:]):
        part = F.col("gram").between(values[low], values[high - 1])
        held = part if held is None else held | part
    return table.where(held)


def _short(needles: DataFrame, index: GramIndex) -> DataFrame:
    """Rows of needles of one or two characters: grams that begin with them, read by range."""
    n = F.length("needle")
    point = lambda k: F.ascii(F.substring("needle", k, 1)).cast("long")
    out = None
    for size in (1, 2):
        prefix = point(1) if size == 1 else F.shiftleft(point(1), BITS).bitwiseOR(point(2))
        some = needles.where(n == size).select("needle", prefix.alias("prefix"))
        edge = some.agg(F.min("prefix"), F.max("prefix")).first()
        if edge[0] is None:
            continue
        width = BITS * (GRAM - size)
        rows = index.grams.where(F.col("gram").between(edge[0] << width, ((edge[1] + 1) << width) - 1)).withColumn("prefix", F.shiftright("gram", width))
        part = rows.join(some, "prefix").select("needle", "block", "found", "gaps")
        out = part if out is None else out.unionByName(part)
    return out


def find_needles(needles: DataFrame, index: GramIndex, payload: Sequence[str]) -> DataFrame:
    """(needle, payload…): every text that holds a needle, once for each pair; ``needles`` is one column, distinct.

    A needle is looked up by its gram with the fewest texts, so no frequent gram is read for it; one with a gram that
    no text has is dropped. Each text found so is searched for the needle. Empty and null needles find nothing.
    """
    needles = cut_lineage(needles.where(F.length("needle") > 0))
    wanted = cut_lineage(wanted_grams(needles))
    counted = wanted.join(in_ranges(index.frequencies, wanted), "gram", "left")
    each = Window.partitionBy("needle")
    drivers = counted.withColumn("missing", F.max(F.col("found").isNull()).over(each)).where(~F.col("missing"))
    drivers = drivers.withColumn("r", F.row_number().over(each.orderBy("found", "gram"))).where("r = 1").select("needle", "gram")
    drivers = cut_lineage(drivers)
    hits = in_ranges(index.grams, drivers).join(small(drivers), "gram").select("needle", "block", "found", "gaps")
    short = _short(needles, index)
    pairs = hits if short is None else hits.unionByName(short)
    few = pairs.agg(F.coalesce(F.sum("found"), F.lit(0))).first()[0] <= BROADCAST_ROWS
    at = pairs.select("needle", "block", "gaps").mapInArrow(_serials, "needle string, serial long").distinct()
    found = (F.broadcast(at) if few else at).join(index.units.select("serial", "hay", *payload), "serial")
    return found.where(F.contains("hay", "needle")).select("needle", *payload)
