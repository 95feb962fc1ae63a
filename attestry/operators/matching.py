"""Literal containment as an equi-join on character n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.session import cut_lineage
from attestry.functions.text import char_grams

GRAM = 3


def rarest_keys(wanted: DataFrame, counted: DataFrame, keys: Sequence[str], scope: Sequence[str], item: str) -> DataFrame:
    """For each key the one item found in the fewest rows; keys with an item never found drop."""
    per_key = Window.partitionBy(*scope, *keys)
    return (
        wanted.join(counted, [*scope, item], "left")
        .withColumn("missing", F.max(F.col("found").isNull()).over(per_key))
        .where(~F.col("missing"))
        .withColumn("r", F.row_number().over(per_key.orderBy("found", item)))
        .where("r = 1")
        .drop("missing", "r", "found")
    )


def contains_join(
    needles: DataFrame,
    texts: DataFrame,
    *,
    needle: str,
    hay: str,
    needle_key: str,
    hay_keys: Sequence[str],
    payload: Sequence[str] = (),
    on: Sequence[str] = (),
) -> DataFrame:
    """Rows (on…, needle_key, hay_keys…, payload…) where the needle occurs in the text.

    A needle can only occur in a text that has all its n-grams.  Each needle is matched
    through the one of its n-grams found in the fewest texts, so a frequent n-gram never
    drives the join, and every candidate is then checked with ``contains``.  Only keys and
    n-grams go through that join; texts are fetched by key for the candidates.  Each pair
    comes out once because a needle has one driving n-gram and a text lists an n-gram once.
    """
    on, hay_keys = list(on), list(hay_keys)
    ids = list(dict.fromkeys([*on, *hay_keys]))
    needles = cut_lineage(needles.select(*on, needle_key, needle).where(F.length(needle) > 0))
    # At most three values: which n-gram lengths the needles ask for.
    sizes = sorted(r[0] for r in needles.select(F.least(F.length(needle), F.lit(GRAM))).distinct().collect()) or [GRAM]
    needle_grams = F.when(F.length(needle) >= GRAM, char_grams(needle, GRAM)).otherwise(F.array(F.col(needle)))
    hay_grams = F.array_distinct(F.flatten(F.array(*[char_grams(hay, n) for n in sizes]))) if len(sizes) > 1 else char_grams(hay, sizes[0])

    wanted = needles.select(*on, needle_key, F.explode(needle_grams).alias("gram"))
    # The n-grams are a column of their own so that exploding them stays in generated code.
    # The outer form keeps the optimizer from computing them again in a size filter.
    spread = texts.select(*ids, hay_grams.alias("grams")).select(*ids, F.explode_outer("grams").alias("gram")).where("gram IS NOT NULL")
    counted = (
        spread.select(*on, "gram")
        .join(wanted.select(*on, "gram").distinct(), [*on, "gram"])
        .groupBy(*on, "gram")
        .agg(F.count(F.lit(1)).alias("found"))
    )
    drivers = rarest_keys(wanted, counted, [needle_key], on, "gram")
    candidates = spread.join(drivers, [*on, "gram"]).select(*ids, needle_key)
    return (
        candidates.join(needles.select(needle_key, needle), needle_key)
        .join(texts.select(*ids, *[c for c in payload if c not in ids], hay), ids)
        .where(F.contains(F.col(hay), F.col(needle)))
        .select(*ids, needle_key, *[c for c in payload if c not in ids])
    )
