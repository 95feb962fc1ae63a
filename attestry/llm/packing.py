"""Variable-capacity best-fit packing.

Documents go into bins of several permitted sizes that are optimised together. Pieces are dealt into packing
groups of bounded size, which pack independently, so the work spreads over the cluster whatever the table's
size. In a group, pieces come longest first; each goes to the open bin that it fills best. When none has room,
a bin is opened in the size that costs least for each token it would hold if it were filled from what is still
to come. At the end every bin is downsized to the smallest permitted size that holds its contents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import store, texts

SIZES = (512, 1024, 2048, 4096)
GROUP = 8192  # pieces that are packed together
OVERHEAD = 8.0  # cost of a bin besides its size, in tokens


def bin_cost(size: int) -> float:
    """What a bin costs to train on: its tokens and a fixed part."""
    return size + OVERHEAD


def pack(lengths: Sequence[int], sizes: Sequence[int], cost: Callable[[int], float] = bin_cost) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each piece; final size and contents of each bin. No piece is longer than the largest size."""
    sizes = sorted(sizes)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left = np.bincount(np.asarray(lengths, np.int64), minlength=sizes[-1] + 1).tolist() if len(lengths) else [0]
    present = sum(1 << n for n in range(1, len(left)) if left[n])  # bit n: a piece of length n is still to come
    room: dict[int, list[int]] = defaultdict(list)  # open bins by the room they have
    roomy = 0  # bit n: some open bin has room n
    chosen, offset = [0] * len(lengths), [0] * len(lengths)
    size_of: list[int] = []
    used: list[int] = []

    def filled(space: int) -> int:
        """Tokens that a bin would get, taking the longest piece that fits again and again."""
        total, taken = 0, defaultdict(int)
        bits = present
        while space > 0:
            n = (bits & ((1 << (space + 1)) - 1)).bit_length() - 1
            if n < 1:
                break
            k = min(left[n] - taken[n], space // n)
            taken[n] += k
            total += k * n
            space -= k * n
            if taken[n] >= left[n] or k == 0:
                bits &= ~(1 << n)
        return total

    for i in order:
        n = lengths[i]
        fit = roomy >> n
        if fit:
            have = (fit & -fit).bit_length() - 1 + n
            b = room[have].pop()
            if not room[have]:
                roomy &= ~(1 << have)
        else:
            size = min((s for s in sizes if s >= n), key=lambda s: (cost(s) / max(filled(s), n, 1), s))
            b, have = len(size_of), size
            size_of.append(size)
            used.append(0)
        chosen[i], offset[i] = b, used[b]
        used[b] += n
        if n:
            left[n] -= 1
            if not left[n]:
                present &= ~(1 << n)
        if have - n > 0:
            room[have - n].append(b)
            roomy |= 1 << (have - n)
    final = [next(s for s in sizes if s >= u) for u in used]
    return chosen, offset, final, used


def with_lengths(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``n``: words of the whole text (runs without ASCII white space) and one end token."""
    texts.small_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            for low, high, raw, at in texts.blocks(batch["text"]):
                _, _, bounds = texts.spans(texts.SPACED_WORD[raw], at)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(low, high - low), pa.array(np.diff(bounds) + 1)], ["id", "n"])

    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return docs.mapInArrow(run, "id long, n long")


def pack_lengths(lengths: DataFrame, sizes: Sequence[int] = SIZES, group: int = GROUP) -> DataFrame:
    """Bins for a table of ``id`` and ``n`` (tokens, 1 at least).

    A document longer than the largest size is cut into pieces of that size and a rest. Returns for each piece
    ``id``, ``piece``, ``first`` (its first token in the document), ``n``, ``bin``, ``start`` (its place in the
    bin), ``bin_size`` and ``bin_used``. Every row of the input is packed: null ids and repeated rows too.
    """
    largest = max(sizes)
    table = store.stored(lengths, "lengths")
    pieces = table.select("id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / largest).cast("int") - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece") * F.lit(largest).cast("long")).alias("first"), F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).alias("n"))
    total = table.agg(F.sum(F.greatest(F.ceil(F.col("n") / largest), F.lit(1)))).first()[0] or 0
    groups = max(1, -(-int(total) // group))
    # The stored rows come in a fixed order, so their numbers are the same in every attempt.
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "id", "piece"], ascending=[False, True, True], kind="stable", na_position="first")
        chosen, offset, final, used = pack(rows["n"].tolist(), sizes)
        b = np.asarray(chosen, np.int64)
        rows["bin"], rows["start"] = b + (int(key[0]) << 24), offset
        rows["bin_size"], rows["bin_used"] = np.asarray(final, np.int64)[b], np.asarray(used, np.int64)[b]
        return rows.drop(columns=["g"])

    return pieces.groupBy("g").applyInPandas(run, "id long, piece int, first long, n long, bin long, start long, bin_size long, bin_used long")


def pack_documents(documents: DataFrame, sizes: Sequence[int] = SIZES, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack_lengths`` for the documents' own lengths; a null or empty text is one end token."""
    return pack_lengths(with_lengths(documents, id_col, text_col), sizes, group)


def op1_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(documents).withColumnRenamed("id", "doc_id")
