"""Ranks and pages of large ordered tables: no task holds a whole group, no page is reached by skipping rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.session import cut_lineage

Order = Sequence[tuple[str, str]]
_INDEX_BITS = 33  # of monotonically_increasing_id: row in its partition


def sort_columns(order: Order) -> list[Column]:
    """``order`` is (column, "asc" or "desc") pairs; nulls come first in rising order and last in falling order."""
    return [F.desc(c) if way == "desc" else F.asc(c) for c, way in order]


def ranked(rows: DataFrame, by: Sequence[str], order: Order, name: str = "position") -> DataFrame:
    """``row_number()`` of ``order`` within ``by`` for groups of any size; ``by`` may be empty.

    Rows are laid out in ranges of group and order, so a large group lies in many partitions. A row's number is its
    place in its partition plus the group's rows in the partitions before, which are summed over one small row per
    group and partition. Rows that are equal in ``order`` lie in one partition and are numbered in any order there.
    Null groups are a group; an empty table gives no rows.
    """
    keys = [*[F.asc(c) for c in by], *sort_columns(order)]
    at = F.monotonically_increasing_id()
    laid = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at))
    part = F.shiftright("_at", _INDEX_BITS)
    groups = [F.col(c).alias(f"_by{k}") for k, c in enumerate(by)]
    names = [f"_by{k}" for k in range(len(by))]
    sums = laid.groupBy(part.alias("_part"), *groups).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    same = part == F.col("_part")
    for c, other in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(other))
    number = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return laid.join(starts, same).select(*[F.col(f"`{c}`") for c in rows.columns], number.cast("long").alias(name))


def beyond(order: Order, key: Mapping[str, Column]) -> Column:
    """Whether a row comes after the key (true, else false or null); plain comparisons, so that they reach the scan."""
    found, same = F.lit(False), F.lit(True)
    for c, way in order:
        own, value = F.col(c), key[c]
        if way == "desc":
            later = value.isNotNull() & ((own < value) | own.isNull())
        else:
            later = F.when(value.isNull(), own.isNotNull()).otherwise(own > value)
        found, same = found | (same & later), same & own.eqNullSafe(value)
    return found


def page_after(rows: DataFrame, order: Order, after: Mapping[str, object] | None = None, size: int = 20) -> DataFrame:
    """The next ``size`` rows after a key, or the first ones: a filter and a bounded top-n in every partition.

    ``order`` must tell all rows apart. ``after`` holds the order columns of the last row that was shown.
    """
    if after is not None:
        kinds = {f.name: f.dataType for f in rows.schema}
        rows = rows.where(beyond(order, {c: F.lit(after[c]).cast(kinds[c]) for c, _ in order}))
    return rows.orderBy(*sort_columns(order)).limit(size)


def page_ends(rows: DataFrame, order: Order, size: int = 20) -> DataFrame:
    """(page, order columns): the last row of every page, from which the next page begins.

    One row a page, none for an empty table; store it and pass it on where many pages are asked for by number.
    """
    at = ranked(rows.select(*[c for c, _ in order]), [], order, "_row")
    total = at.agg(F.max("_row")).scalar()
    last = at.where(((F.col("_row") % size) == 0) | (F.col("_row") == total))
    return last.select(F.ceil(F.col("_row") / size).alias("page"), *[c for c, _ in order])


def numbered_page(rows: DataFrame, order: Order, page: int, size: int = 20, ends: DataFrame | None = None) -> DataFrame:
    """Page ``page`` (from 1) by the key that the page before ends with; empty beyond the last page."""
    if page <= 1:
        return page_after(rows, order, None, size)
    ends = page_ends(rows, order, size) if ends is None else ends
    key = ends.where(F.col("page") == page - 1).select(*[c for c, _ in order]).first()
    return rows.limit(0) if key is None else page_after(rows, order, key.asDict(), size)
